"""N-gram Jaccard self-join by token-combination prefixes: exact, without listing pairs of documents.

Tokens are 64-bit hashes of 3-word shingles; a document is the set of its tokens, and documents with equal sets are one
set with a weight. Two sets are linked if 100 * |x & y| >= 70 * |x | y|.

1. *Prefixes.* Tokens have one order: by the commonness of their rarest word, counted over all texts by bucket, then by
   hash; tokens with a rare word are hardly shared by chance. A set x that is linked to anything misses
   tau = |x| - ceil(0.7 |x|) of its tokens at most, so the first tau + 1 of two linked sets have a token in common, and
   prefixes that are extended by d tokens have 1 + d in common. d is a tenth of the set's size, 2 at least. Tokens that no other prefix has, then
   sets with too few tokens left for any partner, are dropped: exactly, as counts of both are known. Then partners are told apart by 64 hash
   classes: a token that a set has in common only with classes that share too few tokens with it is dropped. A linked partner's class shares
   enough, so this is exact too. It keeps out what large tables have in common by chance, a token here and there, each with another set.
2. *Classes.* A token that ``RARE`` prefixes or fewer have is rare, and a signature by itself; others are frequent, fall
   into sub-classes by hash, and each pair of a sub-class is a signature. There are half as many sub-classes as
   common tokens are sure, so two linked sets share a rare token or a pair, and more than one of them. How many are sure depends on the sizes,
   so pairs are made for each size band that a partner may be in.
3. *Blocks.* A set's label is the set that is the least of most of its signatures' lists, if of as many as linked sets share, else itself.
   Sets of one label share a block of at most about ``BLOCK`` sets and ``BLOCK_TOKENS`` tokens; more of them are spread over several blocks. Two blocks that share as many signatures as linked sets must are a tile. No
   pairs of documents are listed.
4. *Verification.* A tile gets the whole sets of its two blocks and counts all overlaps exactly. It returns, for each set, the weight of its links
   and the least set it is connected to within the tile.
5. *Components.* Those connections are contracted to components; few by union-find in one task, many by rounds of
   label propagation, with a written table for each round.

Cases: null and empty texts have the empty set, which is linked with nothing; 1 or 2 words are one token. Rows that repeat a doc_id count each as
a document of its own with that id; null ids are counted as documents, and are a component's id only if it has no other. An empty table gives no
rows. Extra columns are ignored. A set is known by two 64-bit hashes of its tokens.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import discard, free_name, pieces, released, shuffles_freed, small, written

#: Links need this share, in percent, of the union.
PERCENT = 70
WORDS = 3
#: Words are counted in so many buckets by hash, as a power of two: one byte each is sent to the executors.
BUCKET_BITS = 23
#: Tokens of more prefixes are of the frequent class.
RARE = 256
BLOCK, BLOCK_TOKENS = 256, 400_000
#: Edges between sets that one task contracts by union-find (16 bytes each); more are contracted in rounds.
LOCAL_EDGES = 4_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


# -- tokens


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words one after the other, and each text's number. Words are what ASCII white space parts, A-Z lowered. A hash takes less than finding it in a table would."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    counts = np.array([len(ws) for ws in split], np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(split)), np.uint64, int(counts.sum())), counts


def token_sets(flat: np.ndarray, counts: np.ndarray, common: np.ndarray | None = None, words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct tokens of each text, and how common the rarest word of each is by the table of buckets."""
    out = []
    at = 0
    none = np.zeros(0, np.uint8)
    level = common[flat >> np.uint64(64 - BUCKET_BITS)] if common is not None else none
    with np.errstate(over="ignore"):
        for n in counts.tolist():
            h, c = flat[at : at + n], level[at : at + n]
            at += n
            if n == 0:
                out.append((np.zeros(0, np.uint64), none))
                continue
            k = min(n, words)
            token = np.full(n - k + 1, np.uint64(k))
            for i in range(k):
                token = _mix(token * _M1 + h[i : n - k + 1 + i] * _M2 + _M3)
            if common is None:
                out.append((np.unique(token), none))
                continue
            token, first = np.unique(token, return_index=True)
            rarest = c[: n - k + 1]
            for i in range(1, k):
                rarest = np.minimum(rarest, c[i : n - k + 1 + i])
            out.append((token, rarest[first]))
    return out


def set_ids(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes, signed as the JVM has them."""
    raw = tokens.tobytes()
    return struct.unpack("<qq", struct.pack("<QQ", xxhash.xxh3_64_intdigest(raw), xxhash.xxh64_intdigest(raw, 1)))


def loss(n: int, percent: int = PERCENT) -> int:
    """How many of n tokens a linked set may miss."""
    return n - -(-n * percent // 100)


# -- signatures


def bands(n: int, percent: int = PERCENT) -> range:
    """Size bands (powers of two) that partners of a set of n tokens may be in, its own among them."""
    low, high = -(-n * percent // 100), n * 100 // percent
    return range(low.bit_length(), high.bit_length() + 1)


def extra(n: int) -> int:
    """By how many tokens a prefix is extended."""
    return max(2, -(-n // 10))


def sure(n: int, percent: int = PERCENT) -> int:
    """By how many tokens the prefix of a partner of a set of n tokens is extended, at least: 1 more are common."""
    return extra(-(-n * percent // 100))


def sub_classes(band: int) -> int:
    """Half as many as the common tokens that are sure for sizes of the band."""
    return max(1, sure(1 << max(0, band - 1)) // 2)


def prefix(tokens: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The tokens of a set's prefix. tokens: sorted; common: how common each one's rarest word is."""
    n = len(tokens)
    if n < 3:
        # Only an equal set is linked, and equal sets are one.
        return tokens[:0]
    return tokens[np.argsort(common, kind="stable")[: loss(n, percent) + 1 + extra(n)]]


def combinations(tokens: np.ndarray, band: int) -> np.ndarray:
    """Signatures of the pairs of frequent tokens of one sub-class, in a size band."""
    out = [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        kind = _mix(tokens * _M3) % np.uint64(sub_classes(band))
        order = np.argsort(kind, kind="stable")
        part = tokens[order]
        _, starts, sizes = np.unique(kind[order], return_index=True, return_counts=True)
        for size in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(int(size), 1)
            members = part[starts[sizes == size][:, None] + np.arange(size)]
            a, b = members[:, i].ravel(), members[:, j].ravel()
            low, high = np.minimum(a, b), np.maximum(a, b)
            out.append(_mix(_mix(low + np.uint64(band)) * _M1 + high * _M2))
    return np.concatenate(out)


# -- scans


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, place (the key, or where it is null a hash of the text), _t."""
    k, t = F.col(key).cast("long"), F.col(text).cast("string")
    return docs.select(k.alias("key"), F.coalesce(k, F.xxhash64(t)).alias("place"), t.alias("_t"))


def _survey(docs: DataFrame, key: str, text: str) -> DataFrame:
    """kind 0: key, place, n, h1, h2 of each row. kind 1: how often (n) the distinct sets of a partition have words of the bucket h1, from 2 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        met = np.zeros(1 << BUCKET_BITS, np.uint32)
        names = ["kind", "key", "place", "n", "h1", "h2"]
        for batch in batches:
            for part in pieces(batch, 2):
                flat, counts = word_hashes(part.column(2).to_pylist())
                sets = [s for s, _ in token_sets(flat, counts)]
                ids = [set_ids(s) for s in sets]
                buckets = (flat >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32)
                held = [buckets[:0]]
                for (h, _), end, n in zip(ids, np.cumsum(counts).tolist(), counts.tolist()):
                    if h not in seen:
                        seen.add(h)
                        held.append(buckets[end - n : end])
                values, n = np.unique(np.concatenate(held), return_counts=True)
                met[values] += n.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int8)), part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64())], names)
        values = np.flatnonzero(met > 1)
        for a in range(0, len(values), 100_000):
            some = values[a : a + 100_000]
            m = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), *[pa.nulls(m, pa.int64())] * 2, pa.array(met[some].astype(np.int64)), pa.array(some.astype(np.int64)), pa.nulls(m, pa.int64())], names)

    return _named(docs, key, text).mapInArrow(released(run), "kind tinyint, key bigint, place bigint, n bigint, h1 bigint, h2 bigint")


def _prefixes(docs: DataFrame, text: str, common: np.ndarray) -> DataFrame:
    """sig (a token), set, n (the set's size) of the prefixes of the distinct sets of each partition."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # a byte a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, 0):
                parts, ids, sizes = [np.zeros(0, np.uint64)], [], []
                for s, c in token_sets(*word_hashes(part.column(0).to_pylist()), shared.value):
                    h = set_ids(s)[0]
                    if h not in seen:
                        seen.add(h)
                        parts.append(prefix(s, c))
                        ids.append(h)
                        sizes.append(len(s))
                times = [len(p) for p in parts[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), *(pa.array(np.repeat(np.array(x, np.int64), times)) for x in (ids, sizes))], ["sig", "set", "n"])

    return docs.select(F.col(text).cast("string").alias("_t")).mapInArrow(released(run), "sig bigint, set bigint, n bigint")


def partners(sig: np.ndarray, sets: np.ndarray, many: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct rows sorted by sig: whether several sets have the sig, and for those rows a mask of the hash classes of the others; all classes, if more than many sets have it."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]]))
    sizes = np.diff(starts, append=len(sig))
    several = np.repeat(sizes > 1, sizes)
    sizes = sizes[sizes > 1]
    if not len(sizes):
        return several, np.zeros(0, np.uint64)
    group = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        kind = _mix(sets[several].view(np.uint64)) & np.uint64(63)
    bit = np.uint64(1) << kind
    _, place, count = np.unique(group * 64 + kind.astype(np.int64), return_inverse=True, return_counts=True)
    once = np.bitwise_or.reduceat(bit, np.cumsum(sizes) - sizes)[group]
    mask = np.where(count[place] > 1, once, once & ~bit)
    mask[(sizes > many)[group]] = ~np.uint64(0)
    return several, mask


def _others(prefixes: DataFrame) -> DataFrame:
    """sig, set, n, mask: the distinct rows of tokens that several sets have, with the hash classes of the other sets. Rows of a token with many sets aren't held."""
    many = RARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((3, 0), np.int64)
        large = last = None

        def made(rows: np.ndarray, mask: np.ndarray | None = None) -> pa.RecordBatch:
            mask = np.full(rows.shape[1], ~np.uint64(0)) if mask is None else mask
            return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(mask.view(np.int64))], ["sig", "set", "n", "mask"])

        def whole(rows: np.ndarray) -> pa.RecordBatch:
            several, mask = partners(rows[0], rows[1], many)
            return made(rows[:, several], mask)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([rows, [c.to_numpy() for c in batch.columns]], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
            rows = rows[:, new]
            if large is not None:
                end = int(np.searchsorted(rows[0], large, side="right"))
                again = int(end > 0 and rows[1, 0] == last)
                if end > again:
                    yield made(rows[:, again:end])
                    last = rows[1, end - 1]
                rows = rows[:, end:]
                if not rows.shape[1]:
                    continue
                large = None
            # The last token of a batch may go on in the next.
            cut = int(np.searchsorted(rows[0], rows[0, -1]))
            yield whole(rows[:, :cut])
            rows = rows[:, cut:]
            if rows.shape[1] > many:
                yield made(rows)
                large, last = rows[:2, -1]
                rows = rows[:, :0]
        yield whole(rows)

    return prefixes.repartition("sig").sortWithinPartitions("sig", "set").mapInArrow(released(run), "sig bigint, set bigint, n bigint, mask bigint")


def shared_enough(sets: np.ndarray, n: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Of rows sorted by set, whether one of the row's classes is in enough of its set's rows for a partner."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(sets)), bool), sets[1:] != sets[:-1]]))
    if not len(starts):
        return np.zeros(0, bool)
    bits = np.unpackbits(np.ascontiguousarray(mask, np.dtype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    known = np.maximum(2, ((n[starts] * PERCENT + 99) // 100 + 9) // 10)  # sure(n)
    full = np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > known[:, None]
    full = np.packbits(full, axis=1, bitorder="little").view("<u8").ravel()
    return mask & np.repeat(full, np.diff(starts, append=len(sets))) != 0


def _narrowed(met: DataFrame) -> DataFrame:
    """met: sig, set, n, mask. Gives sig, set, n of those that a linked partner may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def made() -> pa.RecordBatch:
            sig, sets, n, mask = (np.concatenate(c) for c in zip(*held)) if held else [np.zeros(0, np.int64)] * 4
            keep = shared_enough(sets, n, mask.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, sets, n)], ["sig", "set", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns]
            # The last set of a batch may go on in the next.
            if cut := int(np.searchsorted(rows[1], rows[1][-1])):
                held.append([x[:cut] for x in rows])
                yield made()
                held = []
            elif held and held[0][1][0] != rows[1][0]:
                yield made()
                held = []
            held.append([x[cut:] for x in rows])
        yield made()

    ordered = met.select("sig", "set", "n", "mask").repartition("set").sortWithinPartitions("set")
    return ordered.mapInArrow(released(run), "sig bigint, set bigint, n bigint")


def _combined(frequent: DataFrame) -> DataFrame:
    """sig, set: pairs of the frequent tokens (sig, set, n) of each set, in each of its bands. A set's tokens are those of one prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                made = [np.concatenate([combinations(np.asarray(t.values).view(np.uint64), band) for band in bands(n)]) for n, t in zip(part.column(1).to_pylist(), part.column(2))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), [len(m) for m in made]))], ["sig", "set"])

    tokens = frequent.groupBy("set").agg(F.min("n").alias("n"), F.collect_list("sig").alias("tokens")).filter(F.size("tokens") > 1)
    return tokens.mapInArrow(released(run), "sig bigint, set bigint")


def _met(signed: DataFrame) -> DataFrame:
    """Rows (sig, set, ...) of signatures that several sets have, with the least set (low). One shuffle by signature serves both sides."""
    signed = signed.repartition("sig")
    lists = signed.groupBy("sig").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low < high")
    return signed.join(lists.select("sig", "low"), "sig")


def _whole(chosen: DataFrame) -> DataFrame:
    """chosen: set, weight, block, _t. Gives set, weight, block, tokens (binary): once a partition, and only where the text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, 3):
                rows, tokens = [], []
                for i, (name, (s, _)) in enumerate(zip(part.column(0).to_pylist(), token_sets(*word_hashes(part.column(3).to_pylist())))):
                    if name not in seen and set_ids(s)[0] == name:
                        seen.add(name)
                        rows.append(i)
                        tokens.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(rows, pa.int64())) for k in range(3)), pa.array(tokens, pa.binary())], ["set", "weight", "block", "tokens"])

    return chosen.select("set", "weight", "block", "_t").mapInArrow(released(run), "set bigint, weight bigint, block bigint, tokens binary")


# -- verification


def overlaps(sets: list[np.ndarray], ones: list[int], others: list[int], percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ones (places in sets) those of others that it is linked with; a place isn't linked with itself."""
    tokens = np.concatenate([sets[o] for o in others])
    sizes = np.array([len(sets[o]) for o in others])
    owner = np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    places = np.array(others)
    for i in ones:
        s = sets[i]
        low, high = np.searchsorted(tokens, s), np.searchsorted(tokens, s, side="right")
        n = high - low
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        runs = n[hit]
        inner = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        both = np.bincount(owner[np.repeat(low[hit], runs) + inner], minlength=len(others))
        linked = np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (places != i) & (both > 0))
        if len(linked):
            yield i, linked


def _tile(ids: list[int], block: list[int], weights: list[int], sets: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(set, weight of its links here, least set connected to it here) of the sets of a tile. Two blocks: only links between them; one: links within it."""
    kinds = sorted(set(block))
    one = [i for i, b in enumerate(block) if b == kinds[0]]
    other = [i for i, b in enumerate(block) if b == kinds[-1]]
    weight = np.array(weights)
    links = np.zeros(len(ids), np.int64)
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    places = np.array(other)
    for i, linked in overlaps(sets, one, other):
        js = places[linked]
        links[i] += weight[js].sum()
        if len(kinds) == 2:
            links[js] += weight[i]
        for j in js.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [(ids[i], int(links[i]), ids[root(i)]) for i in range(len(ids)) if links[i]]


def _verify(tiled: DataFrame) -> DataFrame:
    """tiled: tile, block, set, weight, tokens. Gives set, links, least. Tiles are streamed in their order; one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, {}, []

        def close() -> None:
            if len(rows) > 1:
                ids, block, weights, raw = map(list, zip(*(rows[k] for k in sorted(rows))))
                out.extend(_tile(ids, block, weights, [np.frombuffer(r, np.uint64) for r in raw]))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in out], pa.int64()) for k in range(3)], ["set", "links", "least"])

        for part in (p for batch in batches for p in pieces(batch, 4)):
            for tile, *row in zip(*(c.to_pylist() for c in part.columns)):
                if tile != now:
                    close()
                    now, rows = tile, {}
                # Rows that repeat a document may bring a set more than once.
                rows[row[0]] = row
            if len(out) > 10_000:
                yield done()
                out.clear()
        close()
        yield done()

    ordered = tiled.select("tile", "set", "block", "weight", "tokens").repartition("tile").sortWithinPartitions("tile")
    return ordered.mapInArrow(released(run), "set bigint, links bigint, least bigint")


# -- components


def _union(edges: np.ndarray) -> dict[int, int]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """a, root of a table of edges (a, b): the least node that each node is connected with."""
    edges = written(edges.filter("a <> b").distinct(), "edges")
    if edges.count() <= local:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
            roots = _union(np.concatenate(pairs)) if pairs else {}
            yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], ["a", "root"])

        return edges.select("a", "b").coalesce(1).mapInArrow(released(run), "a bigint, root bigint")
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both-ways")
    discard(edges)
    roots = table = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")), "roots")
    while True:
        # The least root among the neighbours, then the root's root: paths halve.
        near = both.join(roots.select(F.col("a").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        hooked = roots.join(near, "a").select("a", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jumped = hooked.join(roots.select(F.col("a").alias("root"), F.col("root").alias("rr")), "root", "left").select("a", F.least("root", F.coalesce("rr", "root")).alias("root"), "was")
        following = written(jumped, "roots")
        discard(table)
        table = following
        if following.filter("root <> was").isEmpty():
            discard(both)
            return following.select("a", "root")
        roots = following.select("a", "root")


# -- the join


def similar(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, n_similar (other documents linked directly), component_id (least key reachable): one row for each row."""
    with shuffles_freed(docs.sparkSession):
        return _similar(docs, key, text)


def _similar(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Tables of steps go as soon as the next has been written; the survey and the last stay, as the result reads them."""
    survey = written(_survey(docs, key, text), "survey", by=("kind",))
    rows = survey.filter("kind = 0").select("key", "place", "n", F.col("h1").alias("set"), F.col("h2").alias("check"))
    # How common a bucket's words are, by powers of two; the buckets are bounded, so they may come to the driver. Those of words met three times or less are as rare as any.
    counted = survey.filter("kind = 1").groupBy(F.col("h1").cast("int").alias("bucket")).agg(F.sum("n").alias("n")).filter("n > 3")
    words = counted.select("bucket", F.floor(F.log2("n")).cast("byte").alias("level")).toPandas()
    common = np.zeros(1 << BUCKET_BITS, np.uint8)
    common[words["bucket"].to_numpy()] = words["level"].to_numpy()

    sets = rows.filter("n > 0").groupBy("set", "check").agg(F.min("key").alias("key"), F.min("place").alias("place"), F.count("*").alias("weight"), F.max("n").alias("n"))

    # Tokens that several prefixes have, of sets that have enough of them for a partner.
    met = written(_others(_prefixes(docs, text, common)), "met")
    known = F.greatest(F.lit(2), F.expr(f"((n * {PERCENT} + 99) div 100 + 9) div 10"))  # sure(n)
    need = 1 + F.ceil(known / 2)  # signatures that linked sets share at least
    tokens = written(_narrowed(met), "tokens")
    enough = written(tokens.groupBy("set").agg(F.max("n").alias("n")), "enough")
    discard(met)
    often = tokens.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1")
    classed = tokens.join(often, "sig")
    rare = classed.filter(F.col("c") <= RARE).select("sig", "set")
    shared = written(_met(rare.unionByName(_combined(classed.filter(F.col("c") > RARE)))).select("sig", "set", "low"), "shared")
    discard(tokens)

    # A label for each set, and blocks of bounded size by label.
    votes = shared.groupBy("set", "low").agg(F.count("*").alias("c")).groupBy("set").agg(F.max_by(F.struct("low", "c"), F.struct("c", -F.col("low"))).alias("v"))
    first = votes.join(enough, "set").select("set", F.when(F.col("v.c") >= need, F.col("v.low")).otherwise(F.col("set")).alias("label"))
    first = written(first, "first-labels")
    up = first.select(F.col("set").alias("label"), F.col("label").alias("up"))
    labels = first.join(up, "label", "left").select("set", F.coalesce("up", "label").alias("label"))
    labelled = written(labels.join(sets, "set"), "labelled")
    size = labelled.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("t")).select("label", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("t") / BLOCK_TOKENS)).alias("parts"))
    block = F.xxhash64("label", F.pmod(F.xxhash64("set"), F.col("parts")))
    blocks = written(labelled.join(size, "label").select("set", "place", "weight", "n", block.alias("block")), "blocks")
    discard(enough, first, labelled)

    # Tiles: each block by itself, and two that share a signature.
    thin = small(blocks.select("set", "block"), 16)
    across = shared.join(thin, "set").select("sig", "block").distinct()
    several = across.groupBy("sig").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a < b").select("sig")
    across = written(across.join(several, "sig"), "across")
    discard(shared)
    pairs = across.alias("x").join(across.alias("y"), "sig").filter("x.block < y.block").groupBy(F.col("x.block").alias("a"), F.col("y.block").alias("b")).agg(F.count("*").alias("c"))
    about = blocks.groupBy("block").agg(F.min(need).alias("need"), F.min("n").alias("low"), F.max("n").alias("high"))
    side = lambda x: about.select(F.col("block").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("need", "low", "high")))
    fits = (F.col("c") >= F.greatest("need_a", "need_b")) & (100 * F.col("high_a") >= PERCENT * F.col("low_b")) & (100 * F.col("high_b") >= PERCENT * F.col("low_a"))
    tiles = pairs.join(side("a"), "a").join(side("b"), "b").filter(fits).select("a", "b")
    tiles = written(tiles.unionByName(blocks.groupBy(F.col("block").alias("a")).agg(F.count("*").alias("c")).filter("c > 1").select("a", F.col("a").alias("b"))), "tiles")
    discard(across)
    part = tiles.select(F.xxhash64("a", "b").alias("tile"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))

    # Whole sets of the candidates only, made anew from their texts.
    chosen = small(blocks.select("place", "set", "weight", "block"), 48)
    whole = _whole(_named(docs, key, text).join(chosen, "place"))
    linked = written(_verify(whole.join(small(part, 48), "block").select("tile", "block", "set", "weight", "tokens")), "links")
    discard(blocks, tiles)

    roots = components(linked.select(F.col("set").alias("a"), F.col("least").alias("b")))
    links = linked.groupBy("set").agg(F.sum("links").alias("links"))
    named = sets.select("set", "key", "weight").join(roots.withColumnRenamed("a", "set"), "set", "left").join(links, "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = written(named, "named")
    discard(linked, roots)
    component = named.groupBy("root").agg(F.min("key").alias("component"))
    final = written(named.join(component, "root").filter("links IS NOT NULL OR weight > 1").select("set", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("similar"), "component"), "final")
    discard(named)
    out = rows.join(final, "set", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("similar", F.lit(0)).cast("long").alias("n_similar"), F.when(F.col("n") > 0, F.coalesce("component", "key")).otherwise(F.col("key")).alias("component_id"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the least key, with all its columns. Rows that share this key are all kept; so are rows without a key or without words."""
    judged = similar(docs, key=key, text=text)
    name = free_name(docs, "_nl_gone")
    gone = written(judged.filter(F.col(key) != F.col("component_id")).select(F.col(key).cast("long").alias(name)).distinct(), "duplicates")
    return docs.join(small(gone, 16), docs[key].cast("long") == gone[name], "left_anti")
