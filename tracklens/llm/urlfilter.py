"""URL rules and a digest list (op4).

A blocked URL is found in a sorted array of 64-bit xxhash keys. The array and the full strings are two files, written once
to the shared folder under a name made of their contents; every executor fetches them once (``SparkContext.addFile``) and
memory-maps them. The candidates of a whole batch of URLs are probed by one vectorised binary search, and each hit is
confirmed against the stored full string, so that two strings with one digest are told apart. The list is a sequence or a
table (column ``entry``, any number of rows). It is only sent out up to ``MOST_BYTES``; a longer one stays a table and is
joined (``joined``), with the candidates of each URL as keys.

A list entry is ``host`` or ``host/path``, matched as rules are: it fits its host and all subdomains if the URL's path
starts with the entry's path; an entry without a slash fits any path. Of a URL only those starts of the path and ends of
the host are candidates whose length and number of labels some entry has, however many dots the host holds.

Defined cases: a null URL, an empty one, or one without ``://`` has an empty host and path, no rule, and is allowed;
host labels are compared after A-Z are lower-cased and no other letter; of two rules of one length the one with the
longer host wins; null entries are none; repeated rows are judged alike; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import shared_file, table

#: Above this size, with 16 bytes an entry, a list is joined, not sent to every executor.
MOST_BYTES = 32 << 20
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Hosts that the query blocks where no list is given: the tables hold none.
BLOCKED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: up to ``?`` or ``#``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("?")[0].partition("#")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


def parts(entry: str) -> tuple[str, str]:
    host, slash, path = entry.partition("/")
    return host.translate(_LOWER), slash + path


class Digests:
    """Strings as sorted 64-bit keys, with the strings in the order of their keys, in two memory-mapped files."""

    def __init__(self, keys: str, strings: str):
        self.keys = np.memmap(keys, np.uint64, "r") if os.path.getsize(keys) else np.zeros(0, np.uint64)
        raw = np.memmap(strings, np.uint8, "r")
        n = len(self.keys)
        self.at = raw[: 8 * (n + 1)].view(np.int64)
        self.raw = raw[8 * (n + 1) :]

    @staticmethod
    def pack(entries: Sequence[str], digest=xxhash.xxh64_intdigest) -> tuple[bytes, bytes]:
        """The contents of the two files."""
        ordered = sorted((digest(e), e) for e in {e.encode() for e in entries})
        places = np.cumsum([0] + [len(e) for _, e in ordered], dtype=np.int64)
        return np.array([k for k, _ in ordered], np.uint64).tobytes(), places.tobytes() + b"".join(e for _, e in ordered)

    def find(self, asked: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """For each string whether the list holds it: one binary search for all, then a look at the full strings."""
        h = np.fromiter(map(digest, asked), np.uint64, len(asked))
        i = np.searchsorted(self.keys, h, "left")
        found = np.zeros(len(asked), bool)
        live = np.flatnonzero(i < len(self.keys))
        live = live[self.keys[i[live]] == h[live]]
        for q in live.tolist():
            j = int(i[q])
            while j < len(self.keys) and self.keys[j] == h[q]:  # equal digests stand side by side
                if self.raw[self.at[j] : self.at[j + 1]].tobytes() == asked[q]:
                    found[q] = True
                    break
                j += 1
        return found


class Shape(NamedTuple):
    """Numbers of labels and lengths of the path that occur among some entries."""

    depths: tuple[int, ...]
    lengths: tuple[int, ...]

    @staticmethod
    def of(entries) -> Shape:
        split = [parts(e) for e in entries]
        return Shape(tuple(sorted({h.count(".") + 1 for h, _ in split})), tuple(sorted({len(p) for _, p in split})))


def candidates(host: str, path: str, shape: Shape) -> list[str]:
    """Every entry that could fit."""
    labels = host.rsplit(".", shape.depths[-1]) if host and shape.depths else []  # the first may hold several
    n = host.count(".") + 1
    hosts = [host if d == n else ".".join(labels[-d:]) for d in shape.depths if labels and d <= n]
    return [h + path[:k] for h in hosts for k in shape.lengths if k <= len(path)]


def best_rule(host: str, path: str, rules: dict[str, str], shape: Shape) -> str | None:
    fits = [c for c in candidates(host, path, shape) if c in rules]
    return max(fits, key=lambda c: (len(c), c.find("/"))) if fits else None


_open: dict[tuple[str, str], Digests] = {}


def judge(pages: DataFrame, rules=RULES, blocked: DataFrame | Sequence[str] = BLOCKED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. Rules come first, then the list, then ``allow``."""
    spark = pages.sparkSession
    rules = {"".join(parts(r)): v for r, v in rules}
    if isinstance(blocked, DataFrame):
        size = blocked.agg(F.sum(F.octet_length("entry") + 16)).first()[0] or 0
        if size > most_bytes:
            return joined(pages, rules, blocked)
        blocked = [r.entry for r in blocked.where("entry IS NOT NULL").select("entry").collect()]  # at most ``most_bytes``
    entries = sorted({"".join(parts(b)) for b in blocked})
    if sum(16 + len(e.encode()) for e in entries) > most_bytes:
        return joined(pages, rules, spark.createDataFrame([(e,) for e in entries], "entry string"))
    packed = Digests.pack(entries)
    names = tuple(f"{kind}-{xxhash.xxh3_128_hexdigest(data)}" for kind, data in zip(("keys", "strings"), packed, strict=True))
    for name, data in zip(names, packed, strict=True):
        spark.sparkContext.addFile(shared_file(spark, name, data))
    rule_shape, list_shape = Shape.of(rules), Shape.of(entries)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if names not in _open:
            _open.clear()
            _open[names] = Digests(*map(SparkFiles.get, names))
        digests = _open[names]
        for b in rows:
            split = [host_and_path(u) for u in b.column(1).to_pylist()]
            rule = [best_rule(h, p, rules, rule_shape) for h, p in split]
            asked, whose = [], []
            for i, (h, p) in enumerate(split):
                if rule[i] is None:
                    own = candidates(h, p, list_shape)
                    asked += [c.encode() for c in own]
                    whose += [i] * len(own)
            hit = np.zeros(len(split), bool)
            if asked:
                hit[np.array(whose)[digests.find(asked)]] = True
            verdict = [rules[r] if r is not None else "block" if x else "allow" for r, x in zip(rule, hit.tolist(), strict=True)]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, SCHEMA)


def joined(pages: DataFrame, rules: dict[str, str], entries: DataFrame) -> DataFrame:
    """The same verdicts where the list is too long to send out: distinct hosts and path starts are joined with it.

    Only the numbers of labels and path lengths that occur among the entries reach the driver.
    """
    host = F.substring_index("entry", "/", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    entries = entries.where("entry IS NOT NULL").select(F.concat(lower, F.expr("substr(entry, length(substring_index(entry, '/', 1)) + 1)")).alias("entry"), host.alias("h")).distinct()
    shape = entries.agg(F.array_sort(F.collect_set(F.size(F.split("h", "[.]")))), F.array_sort(F.collect_set(F.length("entry") - F.length("h")))).first()
    none = judge(pages, [*rules.items()], ())
    heads = none.where("rule IS NULL AND host <> ''").select("host", "path").distinct()
    hosts = F.transform(F.filter(F.lit(shape[0] or [0]), lambda d: (d > 0) & (d <= F.size(F.split("host", "[.]")))), lambda d: F.call_function("substring_index", F.col("host"), F.lit("."), -d))
    tails = F.transform(F.filter(F.lit(shape[1] or [0]), lambda n: n <= F.length("path")), lambda n: F.substring("path", 1, n))
    asked = heads.select("host", "path", F.explode(hosts).alias("h")).select("host", "path", "h", F.explode(tails).alias("t"))
    hit = asked.select("host", "path", F.concat("h", "t").alias("entry")).join(entries, "entry", "left_semi").select("host", "path").distinct().withColumn("hit", F.lit(True))
    out = none.join(hit, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull() & F.col("hit"), "block").otherwise(F.col("verdict")).alias("verdict"))


def op4_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    def fits(entry: str) -> str:
        host, path = parts(entry)
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    ranked = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    whens = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ranked)
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
    listed = " OR ".join(f"({fits(b)})" for b in BLOCKED)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {whens} END AS rule FROM split)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN {listed} THEN 'block' ELSE 'allow' END END AS verdict FROM ruled"""
