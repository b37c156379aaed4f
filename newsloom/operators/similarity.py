"""Nearest neighbours by blocked matrix products, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.storage import cut

#: A table is cut into so many blocks, so that rows are sent so many times whatever their number; more only where blocks would be larger than BLOCK_ROWS.
BLOCKS, BLOCK_ROWS = 24, 1 << 16
#: Tasks that tiles are dealt to, and rows of a piece of a tile: a task holds one tile's vectors, and the similarities of one piece.
TASKS, PIECE = 96, 1024
#: Candidates for nearest neighbours that are sorted together.
HELD = 1 << 17


class Side(NamedTuple):
    """Rows of a block: keys in order, vectors of unit length, equal numbers for equal keys, and labels."""

    keys: pa.Array
    unit: np.ndarray
    codes: np.ndarray
    labels: pa.Array


def _side(rows: pa.Table) -> Side:
    rows = rows.take(pc.sort_indices(rows["k"])).combine_chunks()
    keys, v, labels = (rows[c].combine_chunks() for c in ("k", "v", "l"))
    if v.null_count:
        raise ValueError("a row has no vector")
    m = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return Side(keys, np.divide(m, n, out=np.zeros_like(m), where=n > 0), pc.rank(keys, tiebreaker="dense").to_numpy(), labels)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Side, Side | None]]:
    """The tiles of a task, one after the other; the second side is None where a block meets itself."""

    def tile(held: list[pa.RecordBatch]) -> tuple[Side, Side | None]:
        rows = pa.Table.from_batches(held)
        own = rows["i"][0].as_py() == rows["j"][0].as_py()
        return _side(rows.filter(pc.equal(rows["side"], 0))), None if own else _side(rows.filter(pc.equal(rows["side"], 1)))

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        t = batch.column(0).to_numpy()
        ends = [*(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
        for lo, hi in zip([0, *ends], ends):
            if lo == hi:
                continue
            if held and t[lo] != now:
                yield tile(held)
                held = []
            now = t[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield tile(held)


def _scan(df: DataFrame, key: str, vector: str, run: Callable[[Iterator[tuple[Side, Side | None]]], Iterator[pa.RecordBatch]], schema: str, *, rows: int, label: str | None = None) -> DataFrame:
    """What ``run`` gives for tiles: each pair of blocks once. Rows are sent once for each block; pairs of rows are never sent."""
    df = df.filter(F.col(key).isNotNull())
    n = df.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(BLOCKS, -(-n // rows)))
    tasks = min(blocks * (blocks + 1) // 2, TASKS)
    plain = dict(df.dtypes)[vector]
    part = df.select(
        F.col(key).alias("k"), F.col(vector).cast(plain if plain in ("array<float>", "array<double>") else "array<double>").alias("v"), (F.col(label) if label else F.lit(0)).alias("l"),
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("x"),
    )
    tiles = part.select("k", "v", "l", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), (F.col("x") < F.col("b")).cast("int").alias("side"))
    number = (F.col("i") * blocks - F.expr("i * (i - 1) div 2") + F.col("j") - F.col("i")).cast("int")
    dealt = tiles.select(number.alias("t"), "i", "j", "side", "k", "v", "l").repartitionById(tasks, (F.col("t") % tasks).cast("int")).sortWithinPartitions("t")
    return dealt.mapInArrow(lambda batches: run(_grouped(batches)), schema)


def _pieces(a: Side, b: Side | None, size: int = 0, *, half: bool = False) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray | None]]:
    """Ranges of rows and columns, their similarities, and where keys are equal (None: nowhere). half: of a block with itself, pieces below the diagonal are left out."""
    size = size or PIECE
    other = a if b is None else b
    for x in range(0, len(a.unit), size):
        for y in range(x if half and b is None else 0, len(other.unit), size):
            ca, cb = a.codes[x : x + size], other.codes[y : y + size]
            same = ca[:, None] == cb[None, :] if b is None and ca[0] <= cb[-1] and cb[0] <= ca[-1] else None
            yield x, x + len(ca), y, y + len(cb), a.unit[x : x + size] @ other.unit[y : y + size].T, same


def _found(a: Side, b: Side | None, least: float, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column, rounded similarity of pairs of different keys that are at least so similar, each once."""
    for x, _, y, _, sim, same in _pieces(a, b, half=True):
        r, c = np.nonzero(sim > least - 0.51 * 10.0**-digits)
        s = np.round(sim[r, c], digits) + 0.0
        keep = s >= least
        if b is None:
            keep &= (r + x < c + y) & (True if same is None else ~same[r, c])
        yield r[keep] + x, c[keep] + y, s[keep]


class _Best:
    """The k best columns of each row, by (-similarity, position)."""

    def __init__(self, n: int, k: int):
        self.k, self.s, self.o, self.least = k, np.full((n, k), -np.inf), np.zeros((n, k), "i8"), np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def seed(self, at: int, sim: np.ndarray, digits: int) -> None:
        """What the k-th best of a few columns shows: those less similar needn't be looked at."""
        if sim.shape[1] >= self.k:
            self.least[at : at + len(sim)] = np.round(np.partition(sim, -self.k, axis=1)[:, -self.k], digits) - 10.0**-digits

    def offer(self, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        self.held.append((r, c, s))
        if sum(len(h[0]) for h in self.held) >= HELD:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        r, c, s = map(np.concatenate, zip(*self.held))
        self.held = []
        rows, own = np.unique(r, return_inverse=True)
        rr, ss, oo = np.concatenate([np.repeat(np.arange(len(rows)), self.k), own]), np.concatenate([self.s[rows].ravel(), s]), np.concatenate([self.o[rows].ravel(), c])
        order = np.lexsort((oo, -ss, rr))
        rr = rr[order]
        first = order[np.arange(len(rr)) - np.searchsorted(rr, np.arange(len(rows)))[rr] < self.k]
        self.s[rows], self.o[rows] = ss[first].reshape(-1, self.k), oo[first].reshape(-1, self.k)
        self.least[rows] = np.maximum(self.least[rows], self.s[rows, -1])

    def look(self, r0: int, c0: int, sim: np.ndarray, digits: int, *, across: bool = False) -> None:
        """Columns come in the order of their keys, so that an equally similar one further on doesn't count. across: sim has the rows as columns."""
        step = 10.0**-digits
        least = self.least[r0 : r0 + sim.shape[across]] + 0.49 * step
        x, y = np.nonzero(sim > (least if across else least[:, None]))
        s = np.round(sim[x, y], digits) + 0.0
        r, c = (y, x) if across else (x, y)
        keep = s > self.least[r + r0] + 0.5 * step
        if keep.any():
            self.offer(r[keep] + r0, c[keep] + c0, s[keep])

    def batch(self, own: pa.Array, other: pa.Array, names: list[str]) -> pa.RecordBatch:
        self.settle()
        full = np.isfinite(self.s)
        ends = pa.array(np.concatenate([[0], np.cumsum(full.sum(axis=1))]), pa.int32())
        return pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(ends, pa.array(-self.s[full])), pa.ListArray.from_arrays(ends, other.take(pa.array(self.o[full])))], names)


def top_k(df: DataFrame, key: str, vector: str, k: int, *, digits: int = 6, rows: int = 1024) -> DataFrame:
    """key, neighbour, similarity, rank of the k nearest others by (-cosine, id). Each tile gives its own best k, and these are merged."""

    def best(tiles: Iterator[tuple[Side, Side | None]]) -> Iterator[pa.RecordBatch]:
        for a, b in tiles:
            other = a if b is None else b
            mine, theirs = _Best(len(a.unit), k), _Best(len(other.unit), k)
            some = 256
            for one, two, found in [] if b is None else [(a, b, mine), (b, a, theirs)]:
                for at in range(0, len(one.unit), PIECE):
                    found.seed(at, one.unit[at : at + PIECE] @ two.unit[:some].T, digits)
            for x, _, y, _, sim, same in _pieces(a, b):
                if same is not None:
                    sim[same] = -np.inf
                if b is None and y == 0:
                    mine.seed(x, sim[:, :some], digits)
                mine.look(x, y, sim, digits)
                if b is not None:
                    theirs.look(y, x, sim, digits, across=True)
            yield mine.batch(a.keys, other.keys, ["k", "d", "o"])
            if b is not None:
                yield theirs.batch(other.keys, a.keys, ["k", "d", "o"])

    kind = dict(df.dtypes)[key]
    parts = _scan(df, key, vector, best, f"k {kind}, d array<double>, o array<{kind}>", rows=rows)
    merged = parts.groupBy("k").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "o")))), 1, k).alias("t"))
    return merged.select(F.col("k").alias(key), F.posexplode("t").alias("r", "t")).select(key, F.col("t.o").alias("neighbour"), (-F.col("t.d")).alias("similarity"), (F.col("r") + 1).alias("rank"))


def pairs_above(df: DataFrame, key: str, vector: str, least: float, *, digits: int = 6, rows: int = 1024) -> DataFrame:
    """a, b, similarity of all pairs a < b that are at least so similar. They may be as many as pairs there are; linked() and counts() don't list them."""

    def above(tiles: Iterator[tuple[Side, Side | None]]) -> Iterator[pa.RecordBatch]:
        for a, b in tiles:
            for r, c, s in _found(a, b, least, digits):
                x, y = a.keys.take(pa.array(r)), (a if b is None else b).keys.take(pa.array(c))
                swap = pc.greater(x, y)
                yield pa.RecordBatch.from_arrays([pc.if_else(swap, y, x), pc.if_else(swap, x, y), pa.array(s)], ["a", "b", "similarity"])

    kind = dict(df.dtypes)[key]
    return _scan(df, key, vector, above, f"a {kind}, b {kind}, similarity double", rows=rows)


def _unite(root: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    """Joins the sets of r and c; root is the least of a set before and after."""
    while True:
        x, y = root[r], root[c]
        apart = x != y
        if not apart.any():
            return
        r, c, x, y = r[apart], c[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def linked(df: DataFrame, key: str, vector: str, least: float, *, digits: int = 6, rows: int = 1024) -> DataFrame:
    """a, b, units. Rows with b are edges that connect what pairs that are at least so similar connect: in a tile, each member of a set with the set's first. Rows without b have the sum of a's similarities in these pairs, in units of the last digit. Neither lists pairs."""

    def sets(tiles: Iterator[tuple[Side, Side | None]]) -> Iterator[pa.RecordBatch]:
        for a, b in tiles:
            n = len(a.unit)
            keys, shift = (a.keys, 0) if b is None else (pa.concat_arrays([a.keys, b.keys]), n)
            root, units, met = np.arange(len(keys)), np.zeros(len(keys), "i8"), np.zeros(len(keys), bool)
            for r, c, s in _found(a, b, least, digits):
                c, whole = c + shift, np.rint(s * 10.0**digits)
                for side in (r, c):
                    # Sums of whole numbers below 2^53, so floats are exact.
                    units += np.bincount(side, whole, len(keys)).astype("i8")
                    met[side] = True
                _unite(root, r, c)
            inner = np.flatnonzero(root != np.arange(len(keys)))
            some = np.flatnonzero(met)
            first, second = keys.take(pa.array(np.concatenate([root[inner], some]))), keys.take(pa.array(np.concatenate([inner, np.zeros(len(some), "i8")]), mask=np.repeat([False, True], [len(inner), len(some)])))
            yield pa.RecordBatch.from_arrays([first, second, pa.array(np.concatenate([np.zeros(len(inner), "i8"), units[some]]))], ["a", "b", "units"])

    kind = dict(df.dtypes)[key]
    return _scan(df, key, vector, sets, f"a {kind}, b {kind}, units bigint", rows=rows)


def best_other(df: DataFrame, key: str, vector: str, label: str, *, digits: int = 6, rows: int = 1024) -> DataFrame:
    """key, similarity to the most similar row of another key and another label; no row where there is none. A key's rows have all of its labels."""

    def best(tiles: Iterator[tuple[Side, Side | None]]) -> Iterator[pa.RecordBatch]:
        for a, b in tiles:
            ends = [len(a.unit)]
            both = a.labels if b is None else pa.concat_arrays([a.labels, b.labels])
            label_codes = pc.rank(both, tiebreaker="dense").to_numpy()
            # Equal labels are together, so that they are rectangles of a piece.
            sides = [(a, label_codes[: ends[0]])] + ([] if b is None else [(b, label_codes[ends[0] :])])
            sides = [(Side(s.keys.take(pa.array(o)), s.unit[o], s.codes[o], s.labels), l[o]) for s, l in sides for o in (np.argsort(l, kind="stable"),)]
            (a, la), (other, lb) = sides[0], sides[-1]
            mine, theirs = np.full(len(a.unit), -np.inf), np.full(len(other.unit), -np.inf)
            for x in range(0, len(a.unit), PIECE):
                for y in range(0, len(other.unit), PIECE):
                    sim = a.unit[x : x + PIECE] @ other.unit[y : y + PIECE].T
                    p, q = la[x : x + PIECE], lb[y : y + PIECE]
                    for l in np.intersect1d(p, q):
                        sim[slice(*np.searchsorted(p, [l, l + 1])), slice(*np.searchsorted(q, [l, l + 1]))] = -np.inf
                    if b is None:
                        sim[a.codes[x : x + PIECE, None] == other.codes[None, y : y + PIECE]] = -np.inf
                    else:
                        np.maximum(theirs[y : y + PIECE], sim.max(axis=0), out=theirs[y : y + PIECE])
                    np.maximum(mine[x : x + PIECE], sim.max(axis=1), out=mine[x : x + PIECE])
            for keys, m in [(a.keys, mine)] + ([] if b is None else [(other.keys, theirs)]):
                some = np.isfinite(m)
                yield pa.RecordBatch.from_arrays([keys.filter(pa.array(some)), pa.array(np.round(m[some], digits) + 0.0)], [key, "similarity"])

    known = df.filter(F.col(label).isNotNull()).select(key, F.col(label).alias("_l")).distinct()
    each = df.select(key, vector).join(known, key)
    return _scan(each, key, vector, best, f"`{key}` {dict(df.dtypes)[key]}, similarity double", rows=rows, label="_l").groupBy(key).agg(F.max("similarity").alias("similarity"))


def counts(df: DataFrame, key: str, vector: str, *, digits: int = 6, rows: int = 1024) -> DataFrame:
    """units, n: how many of all pairs of keys a < b have a similarity, in units of the last digit. There are 2 * 10^digits + 1 of them at most, however many pairs."""
    scale = 10**digits

    def histogram(tiles: Iterator[tuple[Side, Side | None]]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * scale + 3, "i8")
        for a, b in tiles:
            for x, _, y, _, sim, same in _pieces(a, b, 2 * PIECE, half=True):
                units = np.rint(np.multiply(sim, scale, out=sim), out=sim).astype("i8")
                if b is None:
                    apart = np.arange(x, x + len(units))[:, None] < np.arange(y, y + units.shape[1])[None, :]
                    units = units[apart if same is None else apart & ~same]
                if units.size:
                    low = units.min()
                    seen = np.bincount((units - low).ravel())
                    n[low + scale + 1 : low + scale + 1 + len(seen)] += seen
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some - scale - 1), pa.array(n[some])], ["units", "n"])

    return _scan(df, key, vector, histogram, "units bigint, n bigint", rows=rows).groupBy("units").agg(F.sum("n").alias("n"))


def stats(found: DataFrame, digits: int = 6, levels: tuple[float, ...] = (0.1, 0.3)) -> DataFrame:
    """One row: pairs, low, high, mean, median, deviation, p95 and how many are at least at each level, of counts(). Its rows are bounded by the digits, so that one task may order them."""
    found = cut(found)
    scale, n = 10.0**digits, F.col("n")
    before = F.sum("n").over(Window.orderBy("units").rowsBetween(Window.unboundedPreceding, -1))
    total, mean = found.agg(F.sum("n"), F.sum((F.col("units") * n).cast("decimal(38,0)")).cast("double") / F.sum("n") / scale).first()
    s = F.col("units") / scale
    rows = found.withColumn("_before", F.coalesce(before, F.lit(0)))

    def quantile(p: float) -> Column:
        # The values at the places around it, as percentile() weighs them.
        at = ((total or 1) - 1) * p
        lower, higher = int(at), -int(-at // 1)
        value = lambda place: F.max(F.when(F.col("_before") <= place, s))
        return F.round(value(lower) if lower == higher else (higher - at) * value(lower) + (at - lower) * value(higher), digits)

    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.min(s).alias("low"), F.max(s).alias("high"), F.round(F.lit(mean), digits).alias("mean"), quantile(0.5).alias("median"),
        F.round(F.sqrt(F.sum(n * (s - F.lit(mean)) * (s - F.lit(mean))) / F.sum("n")), digits).alias("deviation"), quantile(0.95).alias("p95"),
        *(F.coalesce(F.sum(F.when(s >= x, n)), F.lit(0)).alias(f"at_{round(x * 100)}") for x in levels),
    )


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node connected with it) of a table of edges (a, b): least labels, with pointer jumping; a cut of lineage each round."""
    edges = edges.select("a", "b")
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("a").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        hooked = roots.join(near, "a").select("a", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        up = roots.select(F.col("a").alias("root"), F.col("root").alias("rr"))
        roots = cut(hooked.join(up, "root", "left").select("a", F.least("root", F.coalesce("rr", "root")).alias("root"), "was"))
        if roots.filter("root <> was").isEmpty():
            return roots.select(F.col("a").alias("node"), "root")
        roots = roots.select("a", "root")


def medoids(sums: DataFrame) -> DataFrame:
    """cluster, medoid of rows (cluster, a, units), the sums of a member's similarities by part: the member with the largest sum, the least of equal ones."""
    whole = sums.groupBy("cluster", "a").agg(F.sum("units").alias("s"))
    return whole.groupBy("cluster").agg(F.min_by("a", F.struct(-F.col("s"), F.col("a"))).alias("medoid"))
