"""Token counts: additive rollups by source, language and tokenizer version, kept up to date by deltas.

A store is a folder. A batch of changes becomes one commit: signed rows that are summed before they are written
(inserts add, deletes take away, a revised count adds its difference to the count before), and the documents' own
counts, from which later batches work out their differences. Totals are the sums over all committed batches; no
batch rewrites another's files. ``compact`` joins the committed batches' files into one generation.

Commits are idempotent. A batch writes to a folder named by its id, and a marker file that appears last makes it count. A
batch whose marker is there does nothing; one that failed half-way is overwritten when it is tried again. Batches
are to be applied one after another; readers see whole batches only.

Changes are rows (doc_id, source, lang, text). Columns that the caller names say what a row does, ``upsert`` (insert or revise) or ``delete``,
and which of a batch's rows of a document is its last, which counts; of equal ones the least by what it does, source, lang, and the text's hash.

Cases: a null or empty text has 0 tokens and counts as a document. Null source and lang are groups of their own. Rows with a
null doc_id can't be revised: each is an insert of its own, deletes of null or unknown ids change nothing. A document that moves to
another source or language leaves its old group. A group that falls to 0 documents is left out. Empty batches commit. Extra columns are ignored, also such as are called op or seq, unless they are named.
A very long text is one string in one task; the tokenizer's time grows with its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import filesystem, fresh_dir

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GROUP = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
_STATE = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, live boolean, step bigint"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, path: str, *, text: str = "text", out: str = "tokens") -> DataFrame:
    """The table without its text, with the number of tokens; path: a .tiktoken file, at the same place on all executors."""
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            counts = pa.array([len(encode(t)) if t else 0 for t in batch.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), counts], [*rest, out])

    kinds = dict(df.dtypes)
    return df.select(*rest, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", `{out}` bigint")


class Rollup:
    """Totals by source, language and tokenizer version in a folder."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str, path: str):
        """tokenizer: the version's name. path: its .tiktoken file."""
        self.spark, self.folder, self.tokenizer, self.path = spark, folder.rstrip("/"), tokenizer, path

    # commits

    def _names(self, kind: FileType) -> list[str]:
        fs, at = filesystem(self.folder)
        return sorted(f.base_name for f in fs.get_file_info(FileSelector(at, allow_not_found=True)) if f.type == kind)

    def committed(self) -> list[str]:
        """Ids of the batches that count, in the order of their commits."""
        fs, at = filesystem(self.folder)
        steps = []
        for name in self._names(FileType.File):
            if name.startswith("commit-"):
                with fs.open_input_stream(f"{at}/{name}") as f:
                    steps.append((int(f.read()), name.removeprefix("commit-")))
        return [b for _, b in sorted(steps)]

    def _mark(self, batch: str, step: int) -> None:
        fs, at = filesystem(self.folder)
        with fs.open_output_stream(f"{at}/.commit-{batch}") as f:
            f.write(str(step).encode())
        fs.move(f"{at}/.commit-{batch}", f"{at}/commit-{batch}")

    # reading

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{what}-{b}" for b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens."""
        summed = self._read("delta", _DELTA).groupBy(*_GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 OR tokens <> 0")

    def counts(self) -> DataFrame:
        """The documents' counts as of the last commit; rows with null ids aren't among them."""
        last = self._read("state", _STATE).filter(F.col("tokenizer") == self.tokenizer).groupBy("doc_id").agg(F.max_by(F.struct("source", "lang", "tokens", "live"), "step").alias("s"))
        return last.filter("s.live").select("doc_id", "s.source", "s.lang", "s.tokens")

    # writing

    def apply(self, batch: str, changes: DataFrame, *, op: str | None = None, seq: str | None = None) -> bool:
        """Commit a batch; False if it was committed before. op, seq: columns with what a row does (else all are upserts) and with its place (else all are equal)."""
        done = self.committed()
        if batch in done:
            return False
        step = len(done) + 1
        rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang")), (F.lit("upsert") if op is None else F.col(op)).alias("op"), (F.lit(0) if seq is None else F.col(seq)).cast("long").alias("seq"), F.col("text").cast("string").alias("text"))
        rows = rows.filter(F.col("doc_id").isNotNull() | (F.col("op") != "delete"))
        # Counted where the texts are; only the counts are shuffled.
        counted = count_tokens(rows.withColumn("_h", F.xxhash64("text")), self.path)
        counted.write.mode("overwrite").parquet(f"{self.folder}/work-{batch}")
        counted = self.spark.read.schema(counted.schema).parquet(f"{self.folder}/work-{batch}")
        # Ids are many and each has few rows, so the window's groups are small; nulls stay out of it.
        order = Window.partitionBy("doc_id").orderBy(F.desc("seq"), "op", "source", "lang", "_h")
        last = counted.filter("doc_id IS NOT NULL").withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")
        state = last.select("doc_id", "source", "lang", F.lit(self.tokenizer).alias("tokenizer"), "tokens", (F.col("op") != "delete").alias("live"), F.lit(step).cast("long").alias("step"))
        state.write.mode("overwrite").parquet(f"{self.folder}/state-{batch}")
        state = self.spark.read.schema(_STATE).parquet(f"{self.folder}/state-{batch}")
        plus = state.filter("live").select("source", "lang", F.lit(1).alias("d"), "tokens")
        minus = self.counts().join(state.select("doc_id"), "doc_id", "left_semi").select("source", "lang", F.lit(-1).alias("d"), (-F.col("tokens")).alias("tokens"))
        loose = counted.filter("doc_id IS NULL").select("source", "lang", F.lit(1).alias("d"), "tokens")
        signed = plus.unionByName(minus).unionByName(loose)
        delta = signed.groupBy("source", "lang").agg(F.sum("d").cast("long").alias("documents"), F.sum("tokens").alias("tokens"))
        delta.select("source", "lang", F.lit(self.tokenizer).alias("tokenizer"), "documents", "tokens").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/delta-{batch}")
        fs, at = filesystem(self.folder)
        fs.delete_dir(f"{at}/work-{batch}")
        self._mark(batch, step)
        return True

    def compact(self, into: Rollup) -> None:
        """Sum all committed deltas, and keep the last states, as the first commit of an empty store."""
        if into.committed():
            raise ValueError("the store to compact into has commits")
        name = "compacted"
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{into.folder}/delta-{name}")
        last = self._read("state", _STATE).groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "tokens", "live"), "step").alias("s")).filter("s.live")
        last.select("doc_id", "s.source", "s.lang", "tokenizer", "s.tokens", "s.live", F.lit(1).cast("long").alias("step")).write.mode("overwrite").parquet(f"{into.folder}/state-{name}")
        into._mark(name, 1)


def squeezed(text: Column) -> Column:
    """The text with each run of white space as its first character alone."""
    return F.regexp_replace(text, r"([\x20\x09-\x0D])[\x20\x09-\x0D]+", "$1")


def rollup_of(docs: DataFrame, tokenizer: str, path: str) -> DataFrame:
    """Totals of a table after three batches: all rows are inserted; texts with runs of white space are revised to have none; of rows with equal
    texts, as they came, all but those with the least id are deleted. Each batch is applied twice, which changes nothing. Rows without an id, or with
    null text, are never deleted."""
    spark = docs.sparkSession
    store = Rollup(spark, fresh_dir(spark, "rollup"), tokenizer, path)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("text").cast("string").alias("text"))
    hashed = thin.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("_h"))
    # Pre-aggregated where the texts are, so a text with many copies sends one row a task.
    least = hashed.groupBy("_h").agg(F.min("doc_id").alias("_low"), F.count("*").alias("_n")).filter("_n > 1")
    copies = hashed.join(least, "_h").filter("doc_id > _low").select("doc_id").distinct()
    for name, rows, op in (
        ("inserted", thin, None),
        ("revised", thin.filter(F.col("doc_id").isNotNull() & (squeezed(F.col("text")) != F.col("text"))).withColumn("text", squeezed(F.col("text"))), None),
        ("deleted", copies.select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"), F.lit("delete").alias("what")), "what"),
    ):
        store.apply(name, rows, op=op)
        store.apply(name, rows, op=op)
    return store.totals()
