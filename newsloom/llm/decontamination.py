"""Benchmark decontamination over a positional inverted index of the training texts.

1. Items are cut into windows of 8 words (an item of fewer words is one window). The frequency of every item term is
   counted over all texts. A window with a term that occurs nowhere can't match; of each other window the two rarest
   terms' places are its anchors.
2. The index stores the postings (term, text, position) of the anchors' terms: a written table.
3. A posting at position p of an anchor at place q of an item lies on the diagonal p - q. Lists are intersected by
   grouping the offset-adjusted postings by (text, item, diagonal): an exact phrase of two words or more has both its
   anchors on one diagonal. A proximity match has postings of three places of the item (two, if the item has no more
   anchors), at as many positions of the text, on diagonals no more than ``slop`` apart. An item with one anchor has none.
4. Candidates are joined to their texts and verified word by word on the diagonal; words in runs of 8 equal ones are
   hit. Texts without candidates only have their words counted.

A text is named by its 64-bit hash within the index; verification runs on each row's own text, so neither copies nor
collisions can make a wrong hit. Terms are matched in full lower case first, letter by letter (``folded``), which never
loses a match, and compared with only A-Z lowered when verified. All is DataFrame operations.

Cases: null and empty texts have no words and no hits, and are spread by a hash of their row. Items with null or empty
text, or a null id, have no windows. Items that share a text each count; an id given twice counts once. Of terms that are
equally rare in a window the first ones are anchors. Rows that repeat are judged each for itself. Empty tables of
documents give no rows, of items no hits. A very long text is one array of words in one task, and each diagonal is
compared over the item's length only. Extra columns stay; where one has the name of ours, ours gets an underscore more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import free_name, salt, small, written

WINDOW = 8
#: The most that the diagonals of a proximity match lie apart.
SLOP = 8
#: What lies between the words of a text, A-Z lowered or not: lowering moves no border between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(text: Column) -> Column:
    """The words of a text as they stand; an empty string comes first if it begins with no word, last if it ends with none."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN, -1)


def n_words(pieces: Column) -> Column:
    """How many words pieces() has: its empty strings, two at most, don't count."""
    ends = (F.element_at(pieces, 1) == "").cast("int") + ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")
    return F.size(pieces) - ends


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def folded(text: Column) -> Column:
    """Lower case that depends on no neighbour: a capital sigma alone would become one of two letters by what follows it."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def _bound(value: Column, use) -> Column:
    """use(value) with the value made once: a plan may put an expression in every place where its column is used, a lambda's variable stays one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def item_table(items: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """_item, _id, _words (A-Z lowered): one row for each distinct item with words."""
    rows = items.select(F.col(item_id).cast("string").alias("_id"), F.filter(F.transform(pieces(F.col(text)), ascii_lower), lambda w: w != "").alias("_words"))
    return rows.filter(F.col("_id").isNotNull() & (F.size("_words") > 0)).distinct().withColumn("_item", F.xxhash64("_id", "_words"))


def _postings(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """_term, _text, _pos of the words that are in terms when folded."""
    every = docs.select(F.xxhash64(F.col(text).cast("string")).alias("_text"), F.posexplode(pieces(folded(F.col(text).cast("string")))).alias("_pos", "_term"))
    return every.join(small(terms, 80), "_term")


def term_counts(docs: DataFrame, terms: DataFrame, *, text: str = "text") -> DataFrame:
    """_term, _tf: occurrences over all texts."""
    return _postings(docs, text, terms).groupBy("_term").agg(F.count("*").alias("_tf"))


def build_index(docs: DataFrame, terms: DataFrame, *, text: str = "text") -> DataFrame:
    """The stored postings of the given terms (column _term, a written table)."""
    return written(_postings(docs, text, terms), "postings")


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """_term, _item, _q, _n (the item's words), _m (its anchors): places of the two rarest terms of each window that can match at all."""
    places = items.select("_item", F.size("_words").alias("_n"), F.posexplode("_words").alias("_q", "_w")).select("_item", "_n", "_q", folded(F.col("_w")).alias("_term"))
    places = places.join(counts, "_term", "left").withColumn("_tf", F.coalesce("_tf", F.lit(0)))
    starts = F.sequence(F.greatest(F.col("_q") - (window - 1), F.lit(0)), F.greatest(F.least(F.col("_q"), F.col("_n") - window), F.lit(0)))
    inside = places.withColumn("_s", F.explode(starts))
    own = Window.partitionBy("_item", "_s")
    ranked = inside.withColumn("_rank", F.row_number().over(own.orderBy("_tf", "_q"))).withColumn("_least", F.min("_tf").over(own))
    chosen = ranked.filter((F.col("_rank") <= 2) & (F.col("_least") > 0)).select("_term", "_item", "_q", "_n").distinct()
    return chosen.withColumn("_m", F.count("*").over(Window.partitionBy("_item")))


def _distinct(low: Column, high: Column, n: Column, total: Column, squares: Column) -> Column:
    """How many different integers there are, 3 for more: low and high are the least and the greatest, and the sum of (x - low) * (high - x) is 0 unless some x lies between."""
    between = (low + high) * total - squares - low * high * n
    return F.when(low == high, F.lit(1)).when(between > 0, F.lit(3)).otherwise(F.lit(2))


def intersect(index: DataFrame, places: DataFrame, slop: int = SLOP) -> DataFrame:
    """_text, _item, _exact (array of diagonals where the rarest lists meet), _near (whether the item has a proximity match)."""
    q = F.col("_q").cast("long")
    aligned = index.join(small(places, 100), "_term").select("_text", "_item", "_n", "_m", q.alias("_q"), (F.col("_pos") - F.col("_q")).alias("_d"))
    # One shuffle for all that follows. Copies of a text repeat its postings, so places are counted as different ones.
    diagonals = aligned.repartition("_text", "_item").groupBy("_text", "_item", "_n", "_m", "_d").agg(
        F.min("_q").alias("_a"), F.max("_q").alias("_b"), F.count("*").alias("_c"), F.sum("_q").alias("_s"), F.sum(F.col("_q") * F.col("_q")).alias("_ss")
    )
    a, b, d = F.col("_a"), F.col("_b"), F.col("_d")
    ahead = Window.partitionBy("_text", "_item").orderBy("_d").rangeBetween(0, slop)
    two = (a < b).cast("long")

    def within(x: Column, y: Column) -> Column:
        """Different ones among all x and y of the diagonals from this one to slop further."""
        return _distinct(F.min(x).over(ahead), F.max(y).over(ahead), F.sum(1 + two).over(ahead), F.sum(x + two * y).over(ahead), F.sum(x * x + two * y * y).over(ahead))

    # A diagonal with three places is a match by itself; one with fewer has no others than the least and the greatest.
    need = F.greatest(F.lit(2), F.least(F.lit(3), F.col("_m")))
    near = (_distinct(a, b, F.col("_c"), F.col("_s"), F.col("_ss")) >= 3) | ((within(a, b) >= need) & (within(d + a, d + b) >= need))
    judged = diagonals.select("_text", "_item", F.when((a < b) | (F.col("_n") == 1), d).alias("_e"), near.alias("_near"))
    met = judged.groupBy("_text", "_item").agg(F.collect_list("_e").alias("_exact"), F.bool_or("_near").alias("_near"))
    return met.filter((F.size("_exact") > 0) | F.col("_near"))


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "marks") -> DataFrame:
    """The table with a column ``out`` (free_name): struct of n_words, hits (sorted positions of hit words), items (sorted ids of items with exact windows), near_items (ids with proximity matches only)."""
    out, key, mine, judged_as = (free_name(docs, c) for c in (out, "_nl_text", "_nl_found", "_nl_judged"))
    tests = written(item_table(items, item_id=item_id, text=item_text), "items")
    vocabulary = written(tests.select(F.explode("_words").alias("_w")).select(folded(F.col("_w")).alias("_term")).distinct(), "vocabulary")
    counts = written(term_counts(docs, vocabulary, text=text), "term-counts")
    places = written(anchors(tests, counts, window), "anchors")
    index = build_index(docs, places.select("_term").distinct(), text=text)
    met = intersect(index, places, slop).join(small(tests, 1000), "_item")
    words = F.when(F.size("_exact") > 0, F.col("_words")).alias("_words")
    found = met.groupBy("_text").agg(F.collect_list(F.struct("_id", words, "_exact", "_near")).alias(mine)).withColumnRenamed("_text", key)
    found = written(found, "candidates")

    body = F.col(text).cast("string")
    base = docs.withColumn(key, F.when(F.length(body) > 0, F.xxhash64(body)).otherwise(salt(docs)))
    rows = base.join(small(found, 2000), key, "left")

    def aligned(w: Column, item: Column):
        """On each diagonal of the text's words w, one character for each word of the item: whether the text has it there."""
        n = F.size(item["_words"])
        width = F.least(n, F.lit(window))

        def on(d: Column) -> Column:
            same = F.array_join(F.transform(item["_words"], lambda x, i: F.when(ascii_lower(F.get(w, d + i)) == x, F.lit("1")).otherwise(F.lit("0"))), "")
            run = F.repeat(F.lit("1"), width)

            def places(s: Column) -> Column:
                # A run within width - 1 places on either side covers the place.
                held = lambda i: F.instr(F.substring(s, F.greatest(i - width + 2, F.lit(1)), F.least(i, width - 1) + width), run) > 0
                return F.when(F.instr(s, run) > 0, F.transform(F.filter(F.sequence(F.lit(0), n - 1), held), lambda i: d + i)).otherwise(F.array().cast("array<int>"))

            return _bound(same, places)

        return F.struct(item["_id"].alias("id"), item["_near"].alias("near"), F.flatten(F.transform(item["_exact"], on)).alias("at"))

    def judged(w: Column) -> Column:
        hits = F.when(F.col(mine).isNotNull(), F.transform(mine, lambda item: aligned(w, item)))
        return F.struct(n_words(w).cast("long").alias("n"), (F.element_at(w, 1) == "").cast("int").alias("lead"), hits.alias("hits"))

    rows = rows.withColumn(judged_as, _bound(pieces(F.col(text)), judged))
    found_here, lead = F.col(judged_as)["hits"], F.col(judged_as)["lead"]
    exact = F.filter(found_here, lambda h: F.size(h["at"]) > 0)
    none = F.array().cast("array<string>")
    ids = F.coalesce(F.array_sort(F.array_distinct(F.transform(exact, lambda h: h["id"]))), none)
    near = F.coalesce(F.array_sort(F.array_distinct(F.transform(F.filter(found_here, lambda h: h["near"]), lambda h: h["id"]))), none)
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform(exact, lambda h: h["at"]))))
    shown = F.when(F.size(exact) > 0, F.transform(hits, lambda p: p - lead)).otherwise(F.array().cast("array<int>"))
    marks = F.struct(F.col(judged_as)["n"].alias("n_words"), shown.alias("hits"), ids.alias("items"), F.array_except(near, ids).alias("near_items"))
    return rows.withColumn(out, marks).select(*(F.col(f"`{c}`") for c in docs.columns), out)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without an exact window of any item, with all their columns."""
    name = free_name(docs, "marks")
    marked = mark(docs, items, window, text=text, item_id=item_id, item_text=item_text, out=name)
    return marked.filter(F.size(f"{name}.items") == 0).drop(name)


def digest_columns(marks: Column | None = None) -> list[Column]:
    """n_words, n_hit, n_items, items_sha256, contaminated and n_near of mark()'s column."""
    m = F.col("marks") if marks is None else marks
    return [
        m["n_words"].alias("n_words"),
        F.size(m["hits"]).cast("long").alias("n_hit"),
        F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"),
        (F.size(m["items"]) >= 2).alias("contaminated"),
        F.size(m["near_items"]).cast("long").alias("n_near"),
    ]
