"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

A rule is ``host/path``. Its digest is xxh64 of that string. The digest file holds the sorted digests,
the text file the rules' strings in the same order with their offsets: a probe that meets a digest reads
the stored string there and counts only if it is equal, so a collision of digests never judges a URL.

A URL's candidates are its host's suffixes at label borders, up to the longest host that a rule has, times the path
prefixes of those lengths that some rule has. Candidates are probed with one ``searchsorted`` for some ten thousand of them.

Cases: a null URL, one without ``://`` and an empty one have an empty host and path, no rule, and the
default verdict. Rules of equal length that fit the same URL can't differ. Repeated rows are judged alike.
Extra columns are ignored, whatever their names. A very long URL takes time in proportion to its length: of its host
only the end can match. An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.shared import filesystem, fresh_dir

#: The rules that the registered query judges by: (verdict, host/path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The most rules one digest file takes (about 100 bytes each on every executor's disk, mapped, not loaded).
MAX_RULES = 20_000_000
DEFAULT = "allow"
#: Candidates that are probed together, about.
_PROBED = 10_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, lower-cased in A-Z only, and path, without query and fragment."""
    start = url.find("://") if url else -1
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def digests(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), np.uint64, len(strings))


class DigestArray:
    """The memory-mapped index: keys sorted, strings confirmed."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n, size, lengths, self.longest_host = np.frombuffer(f.read(32), np.int64).tolist()
        at = 32
        self.keys = np.memmap(path, np.uint64, "r", at, (n,)) if n else np.zeros(0, np.uint64)
        at += 8 * n
        self.ends = np.memmap(path, np.int64, "r", at, (n + 1,))
        at += 8 * (n + 1)
        self.verdicts = np.memmap(path, np.uint8, "r", at, (n,)) if n else np.zeros(0, np.uint8)
        at += n
        self.text = np.memmap(path, np.uint8, "r", at, (size,)) if size else np.zeros(0, np.uint8)
        self.path_lengths = np.fromfile(path, np.int64, lengths, offset=at + size).tolist()

    @staticmethod
    def build(rules, key=digests) -> bytes:
        """The file's bytes: counts and the longest host, sorted keys, offsets, verdicts, strings, and the rules' path lengths. A rule given twice counts once; block wins over allow."""
        kinds: dict[str, str] = {}
        for verdict, rule in rules:
            if verdict not in ("block", "allow") or "/" not in rule:
                raise ValueError(f"not a rule: {verdict} {rule}")
            kinds[rule] = "block" if "block" in (verdict, kinds.get(rule)) else "allow"
        if len(kinds) > MAX_RULES:
            raise ValueError(f"{len(kinds)} rules; one digest file takes {MAX_RULES}")
        strings = sorted(kinds)
        keys = key(strings)
        order = np.argsort(keys, kind="stable")
        raw = [strings[i].encode() for i in order]
        ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        verdicts = np.array([kinds[strings[i]] == "block" for i in order], np.uint8)
        lengths = np.unique([len(s) - s.index("/") for s in strings]).astype(np.int64)
        out = io.BytesIO()
        for part in (np.array([len(strings), ends[-1], len(lengths), max((s.index("/") for s in strings), default=0)], np.int64), keys[order], ends, verdicts):
            out.write(part.tobytes())
        out.write(b"".join(raw))
        out.write(lengths.tobytes())
        return out.getvalue()

    def probe(self, strings: list[str], key=digests) -> np.ndarray:
        """For each string the place of the rule that equals it, or -1."""
        found = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not strings:
            return found
        wanted = key(strings)
        at = np.searchsorted(self.keys, wanted)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)):
            raw, k = strings[i].encode("utf-8", "surrogatepass"), at[i]
            while k < len(self.keys) and self.keys[k] == wanted[i]:
                if self.string(k) == raw:
                    found[i] = k
                    break
                k += 1
        return found

    def string(self, k: int) -> bytes:
        return self.text[self.ends[k] : self.ends[k + 1]].tobytes()


def judge(index: DigestArray, urls, default: str = DEFAULT) -> pd.DataFrame:
    """host, path, rule and verdict of each URL."""
    parts = [split_url(u) for u in urls]
    candidates, owners = [], []
    best: list[tuple[int, int]] = [(-1, -1)] * len(parts)

    def probe() -> None:
        places = index.probe(candidates)
        for j in np.flatnonzero(places >= 0):
            i = owners[j]
            best[i] = max(best[i], (len(candidates[j]), int(places[j])))
        candidates.clear()
        owners.clear()

    for i, (host, path) in enumerate(parts):
        # A suffix begins the host or follows a dot, and is no longer than the longest rule's host.
        at = 0 if len(host) <= index.longest_host else host.find(".", len(host) - index.longest_host - 1) + 1
        while host and (at or len(host) <= index.longest_host):
            for n in index.path_lengths:
                if n <= len(path):
                    candidates.append(f"{host[at:]}{path[:n]}")
                    owners.append(i)
            at = host.find(".", at) + 1
            if not at:
                break
        if len(candidates) >= _PROBED:
            probe()
    probe()
    return pd.DataFrame(
        {
            "host": [h for h, _ in parts],
            "path": [p for _, p in parts],
            "rule": [index.string(k).decode() if k >= 0 else None for _, k in best],
            "verdict": [("block" if index.verdicts[k] else "allow") if k >= 0 else default for _, k in best],
        },
        dtype=object,
    )


def publish(spark: SparkSession, rules) -> str:
    """Write the digest file to the shared folder and have every executor, later ones too, fetch it; returns its name."""
    path = fresh_dir(spark, "digests")
    fs, at = filesystem(path)
    fs.create_dir(at.rsplit("/", 1)[0])
    with fs.open_output_stream(at) as f:
        f.write(DigestArray.build(rules))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def filter_urls(df: DataFrame, rules=RULES, *, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """key, host, path, rule, verdict for every row. Only the two columns are read."""
    name = publish(df.sparkSession, rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = DigestArray(SparkFiles.get(name))
        for pdf in batches:
            out = judge(index, pdf["_url"].where(pdf["_url"].notna(), None), default)
            out.insert(0, key, pdf["_key"].astype(object).where(pdf["_key"].notna(), None))
            yield out

    thin = df.select(df[key].alias("_key"), df[url].cast("string").alias("_url"))
    kind = dict(df.dtypes)[key]
    return thin.mapInPandas(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")
