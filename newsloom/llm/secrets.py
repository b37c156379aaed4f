"""Secret scans: spans of credentials, and weak parts that are reported only where complementary parts are near.

Base spans: ``assign`` (a name such as password, token or api_key with a value of 8 or more characters), ``access``
(AKIA identifiers of 16 or more), ``hex`` (32 or more lower-case hex digits).

Parts that are weak by themselves: ``user`` (a login or client id with its value), ``endpoint`` (a URL with a host, a
host with a port), ``blob`` (40 or more base64 characters with a digit, a lower-case and an upper-case letter). Each
has a role: access identifier (access, user), secret (assign, hex, blob), endpoint. A weak identifier or endpoint is
reported if a secret begins within ``window`` code points of it in the same text, a weak secret if an identifier or an
endpoint does: parts of one credential complement one another.

The link is an interval join: parts are put into cells of ``window`` code points, each weak part looks into its own
cell and the two beside it. Links depend on the text alone, so equal texts are linked once, by digest. All is DataFrame
operations: positions come from splitting a text at a pattern's matches and adding up lengths.

Cases: a null text is empty (and stays null when masked). A document without spans has zero counts and empty strings.
Spans that begin together are in the order of KINDS. Rows that repeat an id are scanned each for itself. Extra columns
stay as they are; where one has the name of ours, ours gets an underscore more. Very long texts only make long arrays
of spans, whose sums take n log n steps; a link looks at three cells, never at all pairs of a document. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import free_name, salt, small, written

WINDOW = 300
#: kind: (pattern in Java's syntax, group that must be long, its least length, role, base)
KINDS: dict[str, tuple[str, int, int, str, bool]] = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, "secret", True),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "access", True),
    "hex": (r"[0-9a-f]{32,}", 0, 32, "secret", True),
    "user": (r"(?<![A-Za-z0-9_])((?i:user(?:name)?|login|client_id|account_id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)", 2, 3, "access", False),
    "endpoint": (r"(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.){1,8}[a-z]{2,12}:[0-9]{2,5})", 0, 1, "endpoint", False),
    "blob": (r"(?<![A-Za-z0-9+/=])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40,}={0,2}", 0, 40, "secret", False),
}
_ORDER = list(KINDS)


def _bound(value: Column, use) -> Column:
    """use(value) with the value made once: a lambda's variable isn't made anew in every place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, both) -> Column:
    """The array's running totals under ``both`` (a sum, a maximum): as many passes as its length has bits, so no array grows element by element."""
    passes = F.greatest(F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"), F.lit(1))
    one = lambda a, k: F.transform(a, lambda x, i: F.coalesce(both(x, F.get(a, i - F.call_function("shiftleft", F.lit(1), k))), x))
    return F.aggregate(F.sequence(F.lit(0), passes - 1), values, one)


_NO_SPANS = "array<struct<start:int,end:int>>"


def spans_of(text: Column, kind: str) -> Column:
    """Array of struct(start, end) in code points: leftmost matches that don't overlap, failing ones dropped afterwards."""
    pattern, group, least, _, _ = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    long_enough = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # What lies before each match, the match, and how long its part is that has to be long.
    cells = F.zip_with(
        F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.char_length(p).alias("p"), F.char_length(m).alias("m"))),
        long_enough,
        lambda c, v: F.struct(c["p"].alias("p"), c["m"].alias("m"), F.char_length(v).alias("v")),
    )

    def placed(c: Column) -> Column:
        ends = _running(F.transform(c, lambda x: x["p"] + x["m"]), lambda x, before: x + before)
        spans = F.zip_with(c, ends, lambda x, e: F.struct((e - x["m"]).alias("start"), e.alias("end"), x["v"].alias("v")))
        return F.transform(F.filter(spans, lambda x: x["v"] >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), _bound(cells, placed)).otherwise(F.array().cast(_NO_SPANS))


def _hay(text: Column) -> dict[str, Column]:
    """A cheap necessary condition of each kind; strings are sought before patterns run."""
    return {
        "assign": text.contains("=") | text.contains(":"),
        "access": text.contains("AKIA"),
        "hex": text.rlike("[0-9a-f]{32}"),
        "user": text.contains("=") | text.contains(":"),
        "endpoint": text.contains(":"),
        "blob": text.rlike("[A-Za-z0-9+/]{40}"),
    }


def parts(text: Column) -> Column:
    """Array of struct(k, start, end) of every part, weak ones too; k is the kind's place in KINDS."""
    hay = _hay(text)

    def of(i: int, kind: str) -> Column:
        placed = F.transform(spans_of(text, kind), lambda s: F.struct(F.lit(i).alias("k"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(hay[kind], placed).otherwise(F.array().cast("array<struct<k:int,start:int,end:int>>"))

    return F.concat(*(of(i, kind) for i, kind in enumerate(_ORDER)))


def links(docs: DataFrame, window: int = WINDOW, *, text: str = "text") -> DataFrame:
    """_key (a text's SHA-1), _links (its weak parts with complementary parts near): one row for each distinct text that has some."""
    t = F.col("_t")
    hay = _hay(t)
    rows = docs.select(F.col(text).cast("string").alias("_t")).filter(hay["user"] | hay["endpoint"] | hay["blob"])
    rows = rows.select(F.sha1(F.encode(t, "UTF-8")).alias("_key"), parts(t).alias("_p")).filter(F.exists("_p", lambda s: s["k"] >= 3) & (F.size("_p") > 1))
    found = written(rows.dropDuplicates(["_key"]), "secret-parts").select("_key", F.explode("_p").alias("_s")).select("_key", "_s.k", "_s.start", "_s.end")
    role = F.array(*(F.lit(KINDS[k][3]) for k in _ORDER))[F.col("k")]
    cell = F.floor(F.col("start") / window)
    weak = found.filter("k >= 3").select("_key", "k", "start", "end", role.alias("role"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    # A cell holds at most `window` starts, so its array is bounded.
    near = found.groupBy("_key", cell.alias("_cell"), role.alias("_role")).agg(F.sort_array(F.collect_set("start")).alias("_starts"))
    met = weak.join(near, ["_key", "_cell"]).filter((F.col("role") != F.col("_role")) & F.exists("_starts", lambda s: F.abs(s - F.col("start")) <= window))
    # An identifier or endpoint needs a secret near; a secret needs either.
    kept = met.filter((F.col("_role") == "secret") | (F.col("role") == "secret")).select("_key", "k", "start", "end").distinct()
    return kept.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("k", "start", "end"))).alias("_links"))


def scan(docs: DataFrame, window: int = WINDOW, *, text: str = "text", out: str = "spans") -> DataFrame:
    """The table with a column ``out`` (free_name): array of struct(start, end, kind, base), by start, then kind."""
    out, key, mine, near = (free_name(docs, c) for c in (out, "_nl_key", "_nl_parts", "_nl_links"))
    linked = written(links(docs, window, text=text), "secret-links").withColumnsRenamed({"_key": key, "_links": near})
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Rows without weak parts get keys that match nothing and spread over the partitions.
    rows = docs.withColumn(mine, parts(t)).withColumn(key, F.when(F.exists(mine, lambda s: s["k"] >= 3), F.sha1(F.encode(t, "UTF-8"))).otherwise(F.concat(F.lit("-"), salt(docs).cast("string"))))
    rows = rows.join(small(linked, 400), key, "left")
    names = F.array(*(F.lit(x) for x in _ORDER))
    every = F.concat(F.filter(mine, lambda s: s["k"] < 3), F.coalesce(near, F.array().cast("array<struct<k:int,start:int,end:int>>")))
    ordered = F.sort_array(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"))))
    spans = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), names[s["k"]].alias("kind"), (s["k"] < 3).alias("base")))
    return rows.withColumn(out, spans).select(*(F.col(f"`{c}`") for c in docs.columns), out)


def _equals(kind: str):
    return lambda x: x == kind


def digest_columns(spans: Column) -> list[Column]:
    """n_assign, n_access, n_hex, base_sha256 and spans of an array of spans."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["base"])
    return [
        *(F.size(F.filter(base.getField("kind"), _equals(k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, shown), ",").alias("spans"),
    ]


#: Code points of a piece of text; a gap between spans is cut from the pieces it lies in, so no cut starts at the text's beginning.
_PIECE = 4096


def _gaps(text: Column, spans: Column) -> Column:
    """What lies before, between and behind spans: they are sorted by start and may overlap, touch or lie in each other."""

    def joined(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: x["end"]), lambda x, before: F.greatest(x, before))
        # A span opens a mask if it begins behind all before it.
        every = F.zip_with(s, reach, lambda x, r: F.struct(x["start"].alias("start"), r.alias("reach")))
        return _bound(every, masks)

    def masks(every: Column) -> Column:
        opens = F.filter(every, lambda x, i: (i == 0) | (x["start"] > F.get(every, i - 1)["reach"]))
        shuts = F.filter(every, lambda x, i: F.coalesce(F.get(every, i + 1)["start"] > x["reach"], F.lit(True)))
        return _bound(opens, lambda o: F.concat(
            F.array(F.struct(F.lit(0).alias("a"), F.get(o, F.lit(0))["start"].alias("b"))),
            F.transform(shuts, lambda x, i: F.struct(x["reach"].alias("a"), F.coalesce(F.get(o, i + 1)["start"], F.char_length(text)).alias("b"))),
        ))

    def cut(pieces: Column):
        def of(g: Column) -> Column:
            p, q = F.floor(g["a"] / _PIECE).cast("int"), F.floor(g["b"] / _PIECE).cast("int")
            at = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
            inside = F.substring(at(p), g["a"] % _PIECE + 1, g["b"] - g["a"])
            head = F.substring(at(p), g["a"] % _PIECE + 1, F.lit(_PIECE))
            return F.when(p == q, inside).otherwise(F.concat(head, F.array_join(F.slice(pieces, p + 2, q - p - 1), ""), F.substring(at(q), F.lit(1), g["b"] % _PIECE)))

        return of

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    return _bound(pieces, lambda p: F.transform(_bound(spans, joined), cut(p)))


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with its spans masked, overlapping and touching ones as one. Without spans it is the text."""
    return F.when(F.size(spans) > 0, F.array_join(_gaps(text, spans), mask)).otherwise(text)
