"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Words of equal length advance together. The hashes of all their substrings probe the sorted keys of the pieces, and a
piece counts if its characters are equal, too. At each place the best candidate is taken by a vectorised maximum that
stores a backpointer.

- Unigram models: the score of a path is the sum of its pieces' scores.
- BPE models: scores are an order of merges, and a maximum of sums isn't what merging gives. Here a step from one piece
  to the next has score 0 if merging would keep that border, else minus infinity: undoing the two pieces' merges, latest
  first, no merge across the border may come before the one that is undone. Of the pieces that end at a place one at
  most can be reached, so the path is the one that merging gives, and ids are the library's.

Text is split into words first; that is exact since no piece has a mark for a space behind another character (checked
when a model is loaded), and no piece has a line end. Runs of spaces have tied scores in some models; such words are
merged one by one. Characters without a piece become their UTF-8 bytes' pieces.

Decoding joins pieces and bytes, and takes off the space that encoding put before the text. It gives the text back
unless that holds U+2581, the mark for a space, which comes back as a space (so it does in the library).

A long word (a text without spaces) is cut where no piece has the two characters side by side: nothing crosses that
place, so its parts are searched as words are. A part that is still long has no others of its length to advance with; it
is searched alone, place by place, or, in a BPE model, merged one by one. Both give the same ids in n log n steps.

Cases: null and empty texts have no ids and decode to an empty text; null ids stay. Repeated rows get equal ids; of paths
with equal sums the one whose last piece is longest is taken. Extra columns are ignored, whatever their names. Texts and
words of any length work, in time that grows with their length; the text and its ids are in memory at once. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import pieces, released

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Text bytes taken at once, and words kept from one batch to the next (twice at most).
_SLICE, _KEEP = 2 << 20, 400_000
#: Words that encode keeps of late; words that are met again are mostly met soon.
_TASK_KEEP = 100_000
#: Characters that a kept word has on average at most.
_WORD = 32
#: Characters of a word beyond which it is cut, and its parts searched alone.
_LONG = 64
#: Cells (words times places times piece lengths) probed at once.
_CELLS = 1 << 21
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


class Model:
    """The vocabulary of a .model file and the tables that the search needs."""

    def __init__(self, path: str, kind: str | None = None):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        types: list[int] = []
        trainer, normalizer = {}, {}
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                types.append(p.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.kind = kind or {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1), "other")
        self.dummy = bool(normalizer.get(3, 1))
        if self.kind == "other" or normalizer.get(2) or normalizer.get(4, 1) or USER in types:
            raise ValueError("only unigram and BPE models without normalisation and user-defined pieces are supported")
        self.types = types
        self.unknown = types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if types[i] == BYTE}
        self.byte_fallback = len(self.bytes) == 256
        self.ids = {p: i for i, p in enumerate(self.pieces) if types[i] == NORMAL}
        odd = [p for p in self.ids if re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p]
        if odd:
            raise ValueError(f"pieces that cross words: {odd[:5]}")
        self.longest = max(map(len, self.ids))
        #: Characters that some piece has side by side. Between others nothing is merged, so a text may be cut there.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.decoded = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, types)]
        self.decoded[self.unknown] = " ⁇ ".encode()
        # Sorted keys, and the characters that confirm them.
        names = list(self.ids)
        codes = np.zeros((len(names), self.longest), np.uint32)
        lengths = np.array([len(p) for p in names])
        for i, p in enumerate(names):
            codes[i, : len(p)] = [ord(c) for c in p]
        keys = np.zeros(len(names), np.uint64)
        for n in range(1, self.longest + 1):
            same = lengths == n
            keys[same] = _hashes(codes[same, :n], n)[:, 0]
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_codes, self.key_lengths = keys[order], codes[order], lengths[order]
        self.key_ids = np.array([self.ids[names[i]] for i in order])
        # Where each beginning of a key (its first 18 bits) starts among the sorted ones: most substrings meet none.
        self.starts = np.searchsorted(self.keys >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32)
        self.lowest = min((s for s, t in zip(self.scores, types) if t == NORMAL), default=0.0) - 10.0
        self.piece_scores = np.array([*self.scores, self.lowest])
        if self.kind == "bpe":
            self._merges()

    # BPE

    def merge(self, word: str, trace: dict | None = None) -> list[str]:
        """Merging one by one: the best score first, then the leftmost. trace gets the last merge."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts) and (k := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, parts[i] + parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            if trace is not None:
                trace["last"] = (parts[i], parts[j])
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _merges(self) -> None:
        """Ranks (single characters below all merges), what each piece was last merged of, and the merges by pair."""
        single = [p for p in self.ids if len(p) == 1]
        tied = {s for s, n in zip(*np.unique([self.scores[self.ids[p]] for p in self.ids if len(p) > 1], return_counts=True)) if n > 1}
        several = sorted((p for p in self.ids if len(p) > 1 and self.scores[self.ids[p]] not in tied), key=lambda p: -self.scores[self.ids[p]])
        #: Characters whose pieces have tied scores; words with two of them in a row are merged one by one.
        self.tied = [p for p in self.ids if len(p) > 1 and self.scores[self.ids[p]] in tied]
        if any(set(p) != {SPACE} for p in self.tied):
            raise ValueError(f"pieces with tied scores: {self.tied[:5]}")
        rank = {p: i for i, p in enumerate(single + several)}
        self.left = np.arange(len(rank))
        self.right = np.arange(len(rank))
        self.rank = np.full(len(self.pieces) + 1, -1)
        pairs = {}
        for p, r in rank.items():
            if len(p) == 1:
                self.rank[self.ids[p]] = r
                continue
            trace: dict = {}
            # A piece that merging its own characters doesn't give never comes up.
            if self.merge(p, trace) == [p]:
                a, b = trace["last"]
                self.rank[self.ids[p]] = r
                self.left[r], self.right[r] = rank[a], rank[b]
                pairs[rank[a] << 32 | rank[b]] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.memo_keys = np.full(1 << 20, -1, np.int64)
        self.memo = np.zeros(1 << 20, bool)

    def kept(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging keeps the border between two pieces, given by rank; remembered for pairs met before."""
        key = one.astype(np.int64) << 32 | two
        slot = ((key.view(np.uint64) * _MIX) >> np.uint64(44)).astype(np.int64)
        known = self.memo_keys[slot] == key
        out = self.memo[slot]
        new = np.flatnonzero(~known)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            answer = self._kept(fresh >> 32, fresh & 0xFFFFFFFF)
            out[new] = answer[back]
            self.memo_keys[slot[new]], self.memo[slot[new]] = key[new], out[new]
        return out

    def _kept(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.ones(len(one), bool)
        live = np.arange(len(one))
        one, two = one.copy(), two.copy()
        limit = np.full(len(one), np.iinfo(np.int64).max)
        while len(live):
            key = one << 32 | two
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            broken = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            out[live[broken]] = False
            # The later merge of the two is undone; where that piece is a character, the other one.
            first = one > two
            l1, r1 = one, self.right[one]
            l2, r2 = two + 1, self.left[two]
            stuck1, stuck2 = r1 == one, r2 == two
            undo1 = np.where(first, ~stuck1, stuck2 & ~stuck1)
            undo2 = np.where(first, stuck1 & ~stuck2, ~stuck2)
            go = ~broken & (undo1 | undo2)
            limit = np.where(undo1, l1, l2)[go]
            one, two, live = np.where(undo1, r1, one)[go], np.where(undo2, r2, two)[go], live[go]
        return out

    # search

    def probe(self, codes: np.ndarray) -> np.ndarray:
        """ids[w, i, n - 1]: the piece of n characters of word w that ends before place i, or -1."""
        m, length = codes.shape
        ids = np.full((m, length + 1, min(self.longest, length)), -1, np.int32)
        for n in range(1, min(self.longest, length) + 1):
            h = _hashes(codes, n)
            wide, h = h.shape[1], h.ravel()
            top = (h >> np.uint64(46)).astype(np.int32)
            some = np.flatnonzero(self.starts[top] < self.starts[top + 1])
            at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            hit = (self.keys[at] == h[some]) & (self.key_lengths[at] == n)
            at = at[hit]
            w, s = np.divmod(some[hit], wide)
            same = (codes[w[:, None], s[:, None] + np.arange(n)] == self.key_codes[at, :n]).all(axis=1)
            w, s, found = w[same], s[same], at[same]
            ids[w, s + n, n - 1] = self.key_ids[found]
        return ids

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, one after the other, and where each word's end; -1 - i stands for a character without a piece that ends at place i."""
        length = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)
        ids = self.probe(codes)
        m, longest = len(words), ids.shape[2]
        none = len(self.pieces)
        best = np.full((m, length + 1), -np.inf)
        best[:, 0] = 0
        last, back = np.full((m, length + 1), -1), np.zeros((m, length + 1), np.int32)
        for i in range(1, length + 1):
            reach = min(i, longest)
            here = np.array(ids[:, i, :reach])
            lone = here[:, 0] < 0
            score = np.full((m, reach), -np.inf)
            for n in range(reach, 0, -1):
                piece = here[:, n - 1]
                ok = np.flatnonzero(piece >= 0)
                if self.kind == "unigram":
                    score[ok, n - 1] = best[ok, i - n] + self.piece_scores[piece[ok]]
                    continue
                ok = ok[np.isfinite(best[ok, i - n]) & (self.rank[piece[ok]] >= 0)]
                before = last[ok, i - n]
                free = (before < 0) | (before == none)
                if not free.all():
                    bound = np.flatnonzero(~free)
                    free[bound] = self.kept(self.rank[before[bound]], self.rank[piece[ok[bound]]])
                score[ok[free], n - 1] = 0
            # A character without a piece borders on everything.
            score[lone, 0] = best[lone, i - 1] + (self.lowest if self.kind == "unigram" else 0)
            n = reach - 1 - np.argmax(score[:, ::-1], axis=1)  # of equal sums, the longest last piece
            back[:, i] = n + 1
            best[:, i] = score[np.arange(m), n]
            last[:, i] = np.where(np.isfinite(best[:, i]), np.where(lone & (n == 0), none, here[np.arange(m), n]), -1)
        # Back from the ends, all words at once; then the pieces on the paths in their order.
        path = np.zeros((m, length + 1), bool)
        rows, at = np.arange(m), np.full(m, length)
        while len(rows):
            path[rows, at] = True
            at = at - back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        place = np.broadcast_to(np.arange(length + 1), path.shape)
        ids = np.where(last == none, -1 - place, last)[path].astype(np.int32)
        ends = np.cumsum(path.sum(axis=1))
        return ids, ends

    def segment(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as 32-bit integers. Long words are cut first; words are searched together, by length."""
        whole: dict[int, list[str]] = {k: self.parts(w) for k, w in enumerate(words) if len(w) > _LONG}
        if not whole:
            return self._segment(words)
        short = [w for k, w in enumerate(words) if k not in whole]
        names = list(dict.fromkeys(p for parts in whole.values() for p in parts))
        ids = self._segment(short + names)
        of, rest = dict(zip(names, ids[len(short) :])), iter(ids)
        return [b"".join(map(of.__getitem__, whole[k])) if k in whole else next(rest) for k in range(len(words))]

    def parts(self, word: str) -> list[str]:
        """The word cut where no piece crosses. Without pieces of bytes, neighbours that both have no piece stay together: they have one id."""
        out, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joined and (self.byte_fallback or word[i] in self.ids or word[i - 1] in self.ids):
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def alone(self, word: str) -> list[int]:
        """The ids of one long word: merges by their order, or the best sum place by place. -1 - i as in search()."""
        if self.kind == "bpe":
            return [self.ids.get(p, -1 - i) for p, i in _ends(self.merge(word))]
        best, back = [0.0], [0]
        for i in range(1, len(word) + 1):
            top, n = -math.inf, 1
            for k in range(min(i, self.longest), 0, -1):
                piece = self.ids.get(word[i - k : i])
                score = best[i - k] + (self.scores[piece] if piece is not None else self.lowest if k == 1 else -math.inf)
                if score > top:
                    top, n = score, k
            best.append(top)
            back.append(n)
        ids, at = [], len(word)
        while at:
            ids.append(self.ids.get(word[at - back[at] : at], -1 - at))
            at -= back[at]
        return ids[::-1]

    def _segment(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Long ones, and words with a run of spaces whose pieces are tied, are searched alone."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > _LONG or self.kind == "bpe" and SPACE + SPACE in w and self.tied:
                out[k] = self._bytes(self.alone(w), w)
            elif w:
                by.setdefault(len(w), []).append(k)
        for length, members in by.items():
            step = max(1, _CELLS // (length * min(length, self.longest)))
            for a in range(0, len(members), step):
                part = members[a : a + step]
                ids, ends = self.search([words[k] for k in part])
                lone = set(np.searchsorted(ends, np.flatnonzero(ids < 0), side="right").tolist())
                raw, begin = ids.tobytes(), 0
                for j, (k, end) in enumerate(zip(part, ends.tolist())):
                    out[k] = self._bytes(ids[begin:end].tolist(), words[k]) if j in lone else raw[4 * begin : 4 * end]
                    begin = end
        return out

    def _bytes(self, ids: list[int], word: str) -> bytes:
        """Packed ids; -1 - i stands for the character that ends at place i."""
        if min(ids, default=0) < 0:
            flat: list[int] = []
            for p in ids:
                if p >= 0:
                    flat.append(p)
                elif self.byte_fallback:
                    flat += [self.bytes[b] for b in word[-2 - p].encode("utf-8", "surrogatepass")]
                elif not flat or flat[-1] != self.unknown:
                    flat.append(self.unknown)
            ids = flat
        return struct.pack(f"<{len(ids)}i", *ids)

    # texts

    def words(self, text: str) -> list[str]:
        """Keys of a text's words: ``x`` stands for a space and x, ``\\nx`` for a line end and x, ``\\n\\nx`` for x at the start of a text that gets no space; one that begins with the mark is as it is."""
        if not text:
            return []
        keys: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if SPACE in line or "  " in line or (i == 0 and (line[:1] == " " or not self.dummy)):
                marked = (SPACE if i == 0 and self.dummy else "") + line.replace(" ", SPACE)
                got = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)
                if i:
                    got = ["\n" + got[0], *got[1:]] if got and got[0][0] != SPACE else ["\n", *got]
                elif got and got[0][0] != SPACE:
                    got = ["\n\n" + got[0], *got[1:]]
                keys += got
            else:
                parts = line.split(" ")
                if i:
                    parts[0] = "\n" + parts[0]
                keys += parts
        return keys

    def encode(self, texts: list[str], cache: Cache) -> list[np.ndarray]:
        keys = [self.words(t or "") for t in texts]
        cache.learn(self, keys)
        get = cache.new.__getitem__
        return [np.frombuffer(b"".join(map(get, k)), np.int32) for k in keys]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _ends(parts: list[str]) -> Iterator[tuple[str, int]]:
    at = 0
    for p in parts:
        at += len(p)
        yield p, at


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Of each row, the hashes of all substrings of n characters."""
    m, length = codes.shape
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        out = np.zeros((m, length - n + 1), np.uint64)
        for k in range(n):
            out = out * _BASE + mixed[:, k : length - n + 1 + k]
        return (out ^ (out >> np.uint64(31))) * _MIX


class Cache:
    """Ids by word key, for the words of late; two generations bound it."""

    def __init__(self, keep: int = _KEEP):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.keep, self.chars = keep, 0

    def learn(self, model: Model, keys: list[list[str]]) -> None:
        if len(self.new) > self.keep or self.chars > _WORD * self.keep:
            self.old, self.new, self.chars = self.new, {}, 0
        wanted = {w for k in keys for w in k}.difference(self.new)
        missing = []
        for w in wanted:
            found = self.old.get(w)
            if found is None:
                missing.append(w)
            else:
                self.new[w] = found
        self.chars += sum(map(len, wanted))
        newline = model._bytes([-2], "\n")
        # A word is cut before its closing punctuation where nothing is merged; what is left is often known.
        heads: dict[str, str] = {}
        for w in missing:
            head = w.rstrip(".,;:!?)")
            if len(head) > 1 and len(head) < len(w) and w[len(head) - 1 : len(head) + 1] not in model.joined and head[0] not in SPACE + "\n":
                heads[w] = head
        tails = {"\n\n" + w[len(h) :] for w, h in heads.items()}
        more = [w for w in {*heads.values(), *tails}.difference(self.new, missing)]
        plain = [w for w in missing if w not in heads] + more
        texts = [w.lstrip("\n") if w[:1] == "\n" else w if w[:1] == SPACE else SPACE + w for w in plain]
        for w, ids in zip(plain, model.segment(texts)):
            self.new[w] = newline + ids if w[:1] == "\n" and w[:2] != "\n\n" else ids
        for w, h in heads.items():
            self.new[w] = self.new[h] + self.new["\n\n" + w[len(h) :]]


@lru_cache(maxsize=2)
def load(path: str, kind: str | None = None) -> Model:
    return Model(path, kind)


_WORKER: dict[str, Cache] = {}


def _worker(path: str, kind: str | None) -> tuple[Model, Cache]:
    """The model and the cache of this Python worker, kept for its next tasks."""
    return load(path, kind), _WORKER.setdefault(f"{path}|{kind}", Cache())


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _SLICE:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", kind: str | None = None) -> DataFrame:
    """key, n_tokens, ids (array of int). path: the .model file, at the same place on all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # This cache goes with its task: a worker that waits, or works for another operator, holds the model only.
        model, cache = load(path, kind), Cache(_TASK_KEEP)
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                ids = model.encode(part.column(1).to_pylist(), cache)
                sizes = np.array([len(i) for i in ids])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), array], [key, "n_tokens", "ids"])

    return docs.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(released(run), f"`{key}` {dict(docs.dtypes)[key]}, n_tokens bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids", kind: str | None = None) -> DataFrame:
    """key, text of a column of ids. Null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = _worker(path, kind)
        for batch in batches:
            out = [model.decode(np.asarray(x.values, np.int32)) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    return encoded.select(key, F.col(ids).alias("_i")).mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, text string")


def round_trip(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", kind: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256, decoded_chars, same: whether the decoded text is the text."""
    names = [key, "n_tokens", "ids_sha256", "decoded_chars", "decoded_sha256", "same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = _worker(path, kind)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for a, b in _slices(texts):
                for t, ids in zip(texts[a:b], model.encode(texts[a:b], cache)):
                    back = model.decode(ids)
                    rows.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), len(back), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (t or "")))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_chars bigint, decoded_sha256 string, same boolean"
    return docs.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, schema)
