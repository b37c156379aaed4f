"""Structure of documents: lines, blocks, tables, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, start, end, line: offsets come from the line lengths inside the row."""
    # Lengths are added up by runs of lines, and runs after that, as an array is copied for every number that is put behind it.
    width = lambda n: F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")
    upto = lambda xs, first: F.aggregate(xs, F.struct(first.alias("at"), F.array().cast("array<int>").alias("s")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["s"], F.array(a["at"])).alias("s")), lambda a: a["s"])
    runs = lambda ls, w: F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / w).cast("int")), lambda i: F.slice(ls, i * w + 1, w))
    sums = lambda rs: F.transform(rs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x))
    with_ = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    starts = lambda ls: with_(runs(ls, width(F.size(ls))), lambda rs: F.flatten(F.zip_with(rs, upto(sums(rs), F.lit(0)), upto)))
    both = lambda parts: F.zip_with(parts, with_(F.transform(parts, lambda x: F.length(x) + 1), starts), lambda x, at: F.struct(x.alias("line"), at.alias("start")))
    rows = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(with_(F.split(text, "\n", -1), both)).alias("line_no", "x"))
    return rows.select(key, "line_no", F.col("x.start").cast("long").alias("start"), (F.col("x.start") + F.length("x.line")).cast("long").alias("end"), F.col("x.line").alias("line"))


def kind_of(line):
    return (
        F.when(F.trim(line) == "", "BLANK").when(line.rlike(r"^\s*\|.*\|\s*$|^[^|]+\|[^|]+\|"), "TABLE").when(line.rlike(r"^#{1,6}\s"), "HEADING").when(line.rlike(r"^\s*([-*+]|\d+[.)])\s"), "LIST").otherwise("PARAGRAPH")
    )


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, block_no, block_type, start, end: runs of lines of one kind; blank lines part them; every heading is its own.

    Runs are found inside the row: a document of any length needs no shuffle."""
    parts = F.split(text, "\n", -1)
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")

    def step(a, x):
        kind, begin = kind_of(x), a["at"]
        end = begin + F.length(x)
        last = F.try_element_at(a["b"], F.lit(-1))
        grows = (last["kind"] == kind) & (kind != "HEADING") & (a["open"] == 1)
        grown = F.concat(F.slice(a["b"], F.lit(1), F.size(a["b"]) - 1), F.array(F.struct(last["kind"].alias("kind"), last["start"].alias("start"), end.alias("end"))))
        fresh = F.concat(a["b"], F.array(F.struct(kind.alias("kind"), begin.alias("start"), end.alias("end"))))
        return F.struct((end + 1).alias("at"), F.when(kind == "BLANK", 0).otherwise(1).alias("open"), F.when(kind == "BLANK", a["b"]).when(grows, grown).otherwise(fresh).alias("b"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("open"), empty.alias("b"))
    found = F.aggregate(parts, start, step, lambda a: a["b"])
    return df.select(key, F.posexplode(found).alias("block_no", "x")).select(key, "block_no", F.col("x.kind").alias("block_type"), "x.start", "x.end")


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """key, chunk_no, start, end, chunk: windows of characters."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = df.select(key, F.col(text).alias("_t"), F.posexplode(starts).alias("chunk_no", "start"))
    return rows.select(key, "chunk_no", F.col("start").cast("long").alias("start"), F.least(F.col("start") + size, F.length("_t")).cast("long").alias("end"), F.substring("_t", F.col("start") + 1, F.lit(size)).alias("chunk"))


def table_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, row_no, col_no, header, value of pipe tables; the first line is the header, separator lines are left out."""
    rows = df.select(key, F.filter(F.split(text, "\n", -1), lambda x: x.contains("|") & ~x.rlike(r"^[\s|:-]+$")).alias("r")).filter(F.size("r") > 0)
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))
    body = rows.select(key, cells(F.col("r")[0]).alias("h"), F.posexplode(F.slice("r", 2, 1_000_000_000)).alias("row_no", "line"))
    flat = body.select(key, "row_no", "h", F.posexplode(cells(F.col("line"))).alias("col_no", "value"))
    return flat.select(key, "row_no", "col_no", F.get("h", F.col("col_no")).alias("header"), "value")
