"""Sharding by a minimax contiguous partition of atomic groups (op8).

Documents with equal texts form one atomic group. Groups stand in the order of their smallest doc_id and are cut into
at most ``n_shards`` contiguous runs so that the largest run has as few bytes as possible: the capacity is found by
binary search, each try is checked greedily, and the cuts are where the greedy check of the smallest feasible
capacity puts them, or as much earlier as leaves a group for each shard that follows, so that no shard is empty while
there are groups. A group larger than an even share forces the capacity up to its own size; it then gets a shard of its
own and the rest is cut anew into the shards that are left.

The driver never sees all groups. It holds sums over at most ``BLOCKS`` ranges of the order; two bounds on the greedy
check (cuts anywhere inside a range, cuts only between ranges) narrow the capacity, and only the ranges in which a cut
can still lie are split further, until every cut lies between two known groups. The result is the exact optimum.

Defined cases: a null text has no bytes (size 1, crc32 0) and groups with other null texts, not with empty ones; an
empty table gives an empty result; a text without any doc_id stands where doc_id -1 would; repeated rows and repeated doc_ids keep one slot each, in any order among equal
rows; columns of the input that clash with result names are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import dropped, fresh, numbered, shared_dir, stored, table

#: Keys as unsigned numbers in the same order: the sign bit changes.
SIGN = 1 << 63
#: Ranges whose sums the driver holds at first, and to which the ranges with cuts are split in each round.
BLOCKS = 4096
SPLIT = 65536


class _Order:
    """What the driver knows of the order: for each range of it the sum, the largest group and the number of groups."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        rows.sort()
        self.key = [(r[0], r[1]) for r in rows]  # first key of the range, level
        self.sum, self.most, self.n = (np.array([r[i] for r in rows], dtype=np.int64) for i in (2, 3, 4))
        self.at = np.concatenate([[0], np.cumsum(self.sum)])

    def place(self, x: int) -> int:
        """The range that holds the byte after the first ``x``."""
        return int(np.searchsorted(self.at, x, "right")) - 1


def _reach(o: _Order, x: int, end: int, cap: int, how: str) -> int:
    """Where a shard ends that begins at ``x``: exact between known groups, else an upper or lower bound."""
    to = x + cap
    if to >= end:
        return end
    i = o.place(to)
    if o.n[i] == 1 or o.at[i] == to or how == "between":
        return max(x, int(o.at[i]))
    return to if how == "anywhere" else max(x, int(o.at[i]), to - int(o.most[i]))


def _shards(o: _Order, spans: list[tuple[int, int]], cap: int, how: str, most: int) -> int:
    n = 0
    for x, end in spans:
        while x < end and n <= most:
            x, was, n = _reach(o, x, end, cap, how), x, n + 1
            if x == was:
                return most + 1
    return n


def _least(lo: int, hi: int, ok) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
    return lo


def cut_points(groups: DataFrame, n_shards: int) -> list[int]:
    """Keys at which the shards after the first begin. ``groups``: key (long, distinct), bytes (long)."""
    low, high = groups.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return []
    unsigned = F.col("key").bitwiseXOR(F.lit(-SIGN))
    level = max(0, ((low + SIGN) ^ (high + SIGN)).bit_length() - (BLOCKS.bit_length() - 1))  # all higher bits are the same

    def summed(df: DataFrame, level: int) -> list[tuple]:
        found = df.groupBy(F.shiftrightunsigned(unsigned, level).alias("b")).agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m"), F.count("*").alias("n")).collect()
        return [((r.b % (2 * SIGN)) << level, level, r.s, r.m, r.n) for r in found]

    rows = summed(groups, level)
    while True:
        o = _Order(rows)
        cuts, doubt = _solve(o, n_shards)
        if not doubt:
            break
        split: dict[int, list[int]] = {}
        for i in doubt:
            split.setdefault(o.key[i][1], []).append(o.key[i][0])
        gone = {k for keys in split.values() for k in keys}
        rows = [r for r in rows if r[0] not in gone or r[4] == 1]
        step = max(1, (SPLIT // len(doubt)).bit_length() - 1)
        for at, keys in split.items():
            chosen = groups.sparkSession.createDataFrame([((k >> at) - 2 * SIGN * (k >> at >= SIGN),) for k in keys], "b long")
            rows += summed(groups.join(F.broadcast(chosen), F.shiftrightunsigned(unsigned, at) == F.col("b"), "left_semi"), max(0, at - step))
    last = sorted(r.key for r in groups.select("key").orderBy(F.desc("key")).limit(n_shards - 1).collect() if r.key != low)
    found = [k - SIGN for k in cuts][: len(last)]
    return [min(x, y) for x, y in zip([*found, *last[len(found) :]], last, strict=True)]


def _solve(o: _Order, k: int) -> tuple[list[int], set[int]]:
    """The cuts, or the ranges that must be split before they are known."""
    total = int(o.at[-1])
    spans, alone = [(0, total)], []
    while spans and len(alone) < k:
        left, size = k - len(alone), sum(b - a for a, b in spans)
        most, which = max((int(o.most[i]), -i) for a, b in spans for i in range(o.place(a), o.place(b - 1) + 1))
        if most * left <= size:
            break  # no group exceeds an even share
        i = -which
        if o.n[i] > 1:
            return [], {i}
        alone.append((int(o.at[i]), int(o.at[i + 1])))
        spans = [s for a, b in spans for s in ([(a, b)] if not a <= o.at[i] < b else [(a, int(o.at[i])), (int(o.at[i + 1]), b)]) if s[0] < s[1]]
        if len(spans) > k - len(alone):  # more runs between huge groups than shards: then the plain optimum holds
            spans, alone = [(0, total)], []
            break
    left, size = k - len(alone), sum(b - a for a, b in spans)
    if not spans:
        marks = sorted({a for a, _ in alone})[1:]
        return [o.key[o.place(x)][0] for x in marks], set()
    most = max(int(o.most[i]) for a, b in spans for i in range(o.place(a), o.place(b - 1) + 1))
    floor = max(most, -(-size // left))
    top = total  # one shard for each run always holds it
    lo = _least(floor, top, lambda c: _shards(o, spans, c, "anywhere", left) <= left)
    hi = _least(lo, top, lambda c: _shards(o, spans, c, "between", left) <= left)
    doubt: set[int] = set()
    ends: list[int] = []
    for a, b in spans:
        x, y = a, a
        while x < b:
            x, y = _reach(o, x, b, lo, "least"), min(b, _reach(o, y, b, hi, "anywhere"))
            first, last = o.place(x), o.place(min(y, total - 1))
            doubt |= {i for i in range(first, last + 1) if o.n[i] > 1 and not (x == y == o.at[i])}
            ends.append(x)
            if len(ends) > 4 * k:
                break
    if doubt or lo < hi:
        if not doubt:
            doubt = {i for i in range(len(o.n)) if o.n[i] > 1}
        return [], doubt
    begins = sorted({a for a, _ in alone} | {a for a, _ in spans} | {x for x in ends if x < total})[1:]
    return [o.key[o.place(x)][0] for x in begins], set()


def assign_shards(docs: DataFrame, n_shards: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the columns ``keep`` of every row; slots of a shard run from 0 without gaps.

    Only digests, sizes and ids are shuffled, never texts. A huge group is spread over many tasks by (key, doc_id).
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("digest"),
        *keep,
    )
    rows = stored(rows, "shard-rows")
    firsts = rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(-1).cast("long")).alias("key"), F.sum("size").alias("bytes"))
    # Two groups never share a smallest doc_id unless doc_ids repeat; then they form one atomic run of the order.
    firsts = stored(firsts, "shard-groups")
    groups = firsts.groupBy("key").agg(F.sum("bytes").alias("bytes"))
    cuts = cut_points(groups, n_shards)
    keyed = rows.join(firsts.select("digest", "key"), "digest")
    shard = F.lit(0)
    for c in cuts:  # at most n_shards - 1
        shard = shard + (F.col("key") >= F.lit(c)).cast("int")
    keyed = keyed.select("doc_id", "size", "text_crc32", "key", shard.alias("shard"), *keep)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    ordered = stored(ranged.select("*", F.monotonically_increasing_id().alias("at")), "shard-order")
    part = F.shiftrightunsigned(F.col("at"), 33)
    counts = ordered.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    before = F.coalesce(F.expr("sum(n) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    offsets = counts.select("part", "shard", "from", before.alias("before"))
    out = ordered.withColumn("part", part).join(offsets, ["part", "shard"])
    out = out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - F.col("from")).cast("long").alias("slot"), *keep)
    out = stored(out, "shards")
    dropped(rows, firsts, ordered)
    return out


def write_shards(docs: DataFrame, path: str, n_shards: int) -> DataFrame:
    """The documents with their shard and slot, written as one folder a shard; returns what was written.

    Every row is written once, also where rows share a doc_id or have none.
    """
    rows, row = numbered(docs.select(*[c for c in docs.columns if c not in ("shard", "slot")]), "shard-documents")
    placed_row = fresh(rows, "placed_row")
    placed = assign_shards(rows, n_shards, (row,)).select(F.col(row).alias(placed_row), "shard", "slot")
    rows.join(placed, F.col(row) == F.col(placed_row)).drop(row, placed_row).write.partitionBy("shard").parquet(path)
    dropped(rows)
    return docs.sparkSession.read.parquet(path)


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return contract(assign_shards(table(spark, sf_dir, "documents"), 16))


def contract(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
