"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of the context that terms stand in.

The lexicon is learned from a bounded sample of labelled rows: words, and stems (beginnings of words), whose documents
are labelled toxic far more often than others. It is held as a trie. The automaton follows all places of the trie that a
word's beginning may have reached with at most one edit; its states are made as words need them and kept, so a word
costs one look-up a character and most die after a few. Stems count without edits only, short terms too.

Each term that is met weighs its log-odds, times what its context says: inside quotation marks, or after a word that
reports or names (said, word, called, ...), it counts less; near a second person it counts more. Features of a
document are the weights of exact terms, of misspelled ones, of quoted ones, and the density of terms; a logistic
regression over the sample, fitted by Newton's method, gives the score. So that it can't learn from what is held out, rows whose
crc32(doc_id) mod 3 is 1 are left out of the sample.

Cases: null and empty texts have no terms and get the score of that. An id that documents repeat is learned from once, by its least text; one that is labelled twice is toxic if one label
says so; labels that are null are left out. Without labels of both kinds every score is 0. Rows with a null id are not
held out. Rows that repeat are scored each for itself; extra columns, whatever their names, are ignored (keep_clean keeps them). A very long
text is scanned in time that grows with its length and the number of its different terms. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import pieces, released

#: Labelled rows that the model is fitted on, at most, of each label; those with the least hash of their id.
SAMPLE = 4000
#: Terms in the lexicon at most.
TERMS = 800
THRESHOLD = 0.7
_STEM = (4, 7)
_SHORTEST_FUZZY = 5
_WORD = re.compile(r"[^\W_]+")
_QUOTES = "\"“”„«»‹›"
_REPORTS = frozenset("said says say word words called calls term quote quoted wrote writes phrase sagte sagt wort nannte dit mot appelé dijo dice palabra llamó".split())
_SECOND = frozenset("you your yours u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes".split())
_NEAR = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


# lexicon


class Lexicon:
    """A trie of weighted terms, and the automaton that finds terms within one edit."""

    def __init__(self, terms: list[tuple[str, str, float]]):
        """terms: (term, 'word' or 'stem', weight)."""
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.fuzzy: set[int] = {0}
        self.letters: set[str] = set()
        for k, (term, kind, _) in enumerate(terms):
            node = 0
            for c in term:
                self.letters.add(c)
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                if kind == "word" and len(term) >= _SHORTEST_FUZZY:
                    self.fuzzy.add(node)
            (self.word if kind == "word" else self.stem)[node] = k
        start = self._closed({(0, 0)})
        self.states: list[frozenset] = [start]
        self.number = {start: 0}
        self.moves: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, int] | None] = [self._accept(start)]

    def _closed(self, places: set[tuple[int, int]]) -> frozenset:
        """Adds places reached by leaving a character out."""
        more = set(places)
        for node, edits in places:
            if edits == 0:
                more.update((x, 1) for x in self.children[node].values() if x in self.fuzzy)
        return frozenset((n, e) for n, e in more if e == 0 or (n, 0) not in more)

    def _step(self, places: frozenset, c: str) -> frozenset:
        out: set[tuple[int, int]] = set()
        for node, edits in places:
            if (x := self.children[node].get(c)) is not None and (edits == 0 or x in self.fuzzy):
                out.add((x, edits))
            if edits == 0:
                if node in self.fuzzy:
                    out.add((node, 1))  # one character too many
                out.update((x, 1) for x in self.children[node].values() if x in self.fuzzy)  # one replaced
        return self._closed(out)

    def _accept(self, places: frozenset) -> tuple[int, int] | None:
        """(edits, term) of the best word that ends here."""
        found = [(e, self.word[n]) for n, e in places if n in self.word and (e == 0 or len(self.terms[self.word[n]][0]) >= _SHORTEST_FUZZY)]
        return min(found, key=lambda x: (x[0], -self.terms[x[1]][2], x[1]), default=None)

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) for a word: the term itself, a stem that it begins with, or a term within one edit."""
        state = 0
        node, stem = 0, None
        for c in word:
            if node >= 0:
                node = self.children[node].get(c, -1)
                stem = self.stem.get(node, stem)
            if state >= 0:
                key = c if c in self.letters else "\0"
                following = self.moves[state].get(key)
                if following is None:
                    places = self._step(self.states[state], key)
                    following = -1
                    if places:
                        following = self.number.get(places, len(self.states))
                        if following == len(self.states):
                            self.number[places] = following
                            self.states.append(places)
                            self.moves.append({})
                            self.accepts.append(self._accept(places))
                    self.moves[state][key] = following
                state = following
            if state < 0 and node < 0:
                break
        got = self.accepts[state] if state >= 0 else None
        if got and got[0] == 0:
            return got
        return (0, stem) if stem is not None else got


# features


class Scanner:
    """Features of texts. Words that met no term are remembered, up to a bound."""

    FEATURES = 5

    def __init__(self, lexicon: Lexicon, keep: int = 400_000):
        self.lexicon, self.keep = lexicon, keep
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def features(self, text: str) -> list[float]:
        lower = text.lower()
        words = set(_WORD.findall(lower))
        met = []
        for w in words.difference(self.clean):
            found = self.hits.get(w) or self.lexicon.find(w)
            if found is None:
                self.clean.add(w)
            else:
                self.hits[w] = found
                met.append(w)
        if len(self.clean) > self.keep:
            self.clean.clear()
        if len(self.hits) > self.keep:
            self.hits.clear()
        if not met:
            return [0.0] * self.FEATURES
        hits = {w: self.hits.get(w) or self.lexicon.find(w) for w in met}
        exact = fuzzy = quoted = 0.0
        n = 0
        for m in re.finditer(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, met), key=len, reverse=True)) + r")(?![^\W_])", lower):
            edits, term = hits[m[0]]
            weight, (calm, harsh) = self.lexicon.terms[term][2], self.context(lower, m.start(), m.end())
            n += 1
            if calm:
                quoted += weight
            elif edits:
                fuzzy += weight * (1.5 if harsh else 1)
            else:
                exact += weight * (1.5 if harsh else 1)
        return [min(exact, 12.0), min(math.log1p(exact), 5.0), math.log1p(fuzzy), math.log1p(quoted), min(1.0, 20 * n / (1 + len(words)))]

    def context(self, text: str, start: int, end: int) -> tuple[bool, bool]:
        """Whether a term is quoted or reported, and whether it is near a second person."""
        left, right = text[max(0, start - 80) : start], text[end : end + 80]
        before, after = left.split()[-_NEAR:], right.split()[:_NEAR]
        line, rest = left.rsplit("\n", 1)[-1], right.split("\n", 1)[0]
        open_mark = max((line.rfind(q) for q in _QUOTES), default=-1)
        # An odd number of marks before it, and one behind it on the same line, enclose it.
        enclosed = open_mark >= 0 and sum(line.count(q) for q in _QUOTES) % 2 == 1 and any(q in rest for q in _QUOTES)
        bare = [w.strip(".,;:!?'()[]" + _QUOTES) for w in before]
        near = bare + [w.strip(".,;:!?'()[]" + _QUOTES) for w in after]
        return enclosed or not _REPORTS.isdisjoint(bare), not _SECOND.isdisjoint(near)


# learning


class Model:
    """A lexicon and the weights of the features; the first weight is the intercept. None: no labels of both kinds."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def sample_of(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, toxic: of each label the rows with the least hashes, none of them held out."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [one.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def learn_lexicon(rows: DataFrame, n_toxic: int, n_other: int, terms: int = TERMS) -> Lexicon:
    """rows: _t, toxic. Document frequencies of words and stems by label, on the executors; only the best terms come to the driver."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > _STEM[0]), lambda w: F.transform(F.sequence(F.lit(_STEM[0]), F.least(F.length(w) - 1, F.lit(_STEM[1]))), lambda k: F.substring(w, F.lit(1), k)))))
    every = F.concat(F.transform(words, lambda w: F.struct(w.alias("term"), F.lit("word").alias("kind"))), F.transform(stems, lambda w: F.struct(w.alias("term"), F.lit("stem").alias("kind"))))
    counts = rows.select("toxic", F.explode(every).alias("x")).groupBy("x.term", "x.kind").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_toxic + 1)) - F.log((F.col("neg") + 0.5) / (n_other + 1))
    least = max(3, round(0.01 * n_toxic))
    best = counts.withColumn("odds", odds).filter((F.col("pos") >= F.when(F.col("kind") == "stem", 2 * least).otherwise(least)) & (F.col("odds") > 4.0))
    got = best.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "kind", "term").limit(terms).collect()
    stems_kept: list[str] = []
    out: list[tuple[str, str, float]] = []
    words_kept = {r.term: r.pos for r in got if r.kind == "word"}
    for r in sorted((r for r in got if r.kind == "stem"), key=lambda r: (len(r.term), r.term)):
        # A stem that is only there for one word, or that a shorter one covers, says nothing more.
        alone = max((p for w, p in words_kept.items() if w.startswith(r.term)), default=0)
        if alone < 0.6 * r.pos and not any(r.term.startswith(s) for s in stems_kept):
            stems_kept.append(r.term)
            out.append((r.term, "stem", min(float(r.odds), 6.0)))
    for r in got:
        if r.kind == "word" and not any(r.term.startswith(s) for s in stems_kept):
            out.append((r.term, "word", min(float(r.odds), 6.0)))
    return Lexicon(sorted(out))


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(features), 1)), features])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (labels - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, terms: int = TERMS) -> Model:
    """Fit on at most ``size`` rows of each label. Their features, not their texts, come to the driver."""
    sample = F.broadcast(sample_of(labels, size))  # at most 2 * size rows
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")).join(sample, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("_t").alias("_t"), F.max("toxic").cast("int").alias("toxic")).select("_t", "toxic")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model(Lexicon([]), None)
    lexicon = learn_lexicon(rows, n[1], n[0], terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for part in (p for batch in batches for p in pieces(batch, 0)):
            f = np.array([scanner.features(t) for t in part.column(0).to_pylist()]).reshape(-1, Scanner.FEATURES)
            yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(f[:, i]) for i in range(Scanner.FEATURES))], ["toxic", *(f"f{i}" for i in range(Scanner.FEATURES))])

    got = rows.mapInArrow(released(run), "toxic int, " + ", ".join(f"f{i} double" for i in range(Scanner.FEATURES))).toPandas().sort_values(["toxic", *(f"f{i}" for i in range(Scanner.FEATURES))])
    return Model(lexicon, fit(got.iloc[:, 1:].to_numpy(), got["toxic"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.lexicon)
        for part in (p for batch in batches for p in pieces(batch, 1)):
            f = np.array([scanner.features(t or "") for t in part.column(1).to_pylist()]).reshape(-1, Scanner.FEATURES)
            s = model.scores(f)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(s >= threshold).cast(pa.int32())], [key, "score", "predicted"])

    return docs.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(released(run), f"`{key}` {dict(docs.dtypes)[key]}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, *, text: str = "text") -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    n = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.lexicon)
        for part in (p for batch in batches for p in pieces(batch, n)):
            f = np.array([scanner.features(t or "") for t in part.column(n).to_pylist()]).reshape(-1, Scanner.FEATURES)
            yield part.filter(pa.array(model.scores(f) < threshold))

    return docs.mapInArrow(released(run), docs.schema)
