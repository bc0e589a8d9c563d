"""Cosine similarity of all vectors, as edges above a threshold.

The angle between vectors is a metric on the sphere. Up to ``MOST_PIVOTS`` vectors are pivots; each vector belongs to the
cell of its nearest pivot, and a cell of more than ``BLOCK`` vectors is split by the angle to its pivot into blocks. Blocks
are laid together in packs, rows of bytes, and a cross join brings every two packs together without a shuffle: vectors are
shuffled once, whatever their number. Inside, a vector meets a block only if no pivot proves, by the triangle inequality,
that everything in it is too far: for every pivot the vector's angle must be within the threshold's angle of the range that
the block has. Two blocks are matrix products in an Arrow function, so every pair of vectors is decided once and only edges
leave the task. Where the vectors have no clusters nothing can be proved, and the work is that of all pairs, in blocks
(``products`` counts it). ``links`` needs the components only and spares most of that. ``approximate_edges``, random
projections that compare neighbours only, may miss edges and grows less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.functions.text import cosine
from tracklens.sources.durable import dropped, stored

#: Vectors in a block; vectors for each pivot, and the most pivots: their angles are a matrix that every task gets.
BLOCK, CELL, MOST_PIVOTS = 4096, 512, 256
#: Blocks in a pack, where there are more than so many packs; vectors that are compared with all others in a round of ``links``.
PACK, CENTRES = 16, 2048
TOLD = ["id", "u", "cell", "band", "label", "root", "other"]
#: Angles near 0 are right to some 1e-8.
MARGIN = 1e-6


def usable(vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """id and v of vectors with ``dim`` numbers and a length above zero."""
    v = F.col(column).cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return vectors.where((F.size(v) == dim) & (norm > 0)).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def _matrix(rows: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    u = rows.column("u")
    return (u.combine_chunks() if isinstance(u, pa.ChunkedArray) else u).flatten().to_numpy().reshape(-1, dim)


def placed(rows: DataFrame, dim: int, block: int = BLOCK, cell: int = CELL) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Unit vectors with their cell, band and angle; the blocks (cell, band, n); the pivots. ``rows``: as ``usable``."""
    total = rows.count()
    chosen = rows.orderBy(F.xxhash64("id"), "v").limit(min(MOST_PIVOTS, -(-total // cell))).select("v").collect()
    pivots = np.array([r.v for r in chosen]).reshape(-1, dim)
    pivots = pivots / np.sqrt((pivots * pivots).sum(axis=1, keepdims=True))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy().reshape(-1, dim)
            u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
            angles = _angles(u, pivots)
            own = angles.argmin(axis=1)
            yield pa.record_batch([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), dim).cast(pa.list_(pa.float64())), pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])], names=["id", "u", "cell", "angle"])

    near = stored(rows.mapInArrow(nearest, "id long, u array<double>, cell int, angle double"), "cells")
    # A large cell is cut at quantiles of the angle; where many angles are equal some cuts are too, and a hash deals among them.
    cells = near.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("angle", [i / 1000 for i in range(1001)], 10_000).alias("q"))
    bands = F.ceil(F.col("n") / block)
    at = lambda i: F.get("q", F.floor(i * 1000 / bands).cast("int"))
    cuts = cells.select("cell", F.when(bands > 1, F.transform(F.sequence(F.lit(1), bands - 1), at)).otherwise(F.array().cast("array<double>")).alias("cuts"))
    cut = near.join(F.broadcast(cuts), "cell")  # a row for each pivot
    below, equal = (F.size(F.filter("cuts", f)) for f in (lambda q: q < F.col("angle"), lambda q: q == F.col("angle")))
    inside = stored(cut.select("id", "u", "cell", (below + F.pmod(F.xxhash64("id"), equal + 1)).cast("int").alias("band"), "angle"), "blocks")
    dropped(near)
    return inside, stored(inside.groupBy("cell", "band").agg(F.count("*").alias("n")), "ranges"), pivots


class _Pack:
    """Vectors of one pack, sorted by block, with their angles to the pivots and the range that each block has."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, block: np.ndarray, label: np.ndarray, pivots: np.ndarray):
        self.ids, self.u, self.label, self.n = ids, u, label, len(ids)
        self.angles = np.concatenate([_angles(u[i : i + 8192], pivots).astype(np.float32) for i in range(0, self.n, 8192)])
        self.begin = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        self.end = np.append(self.begin[1:], self.n)
        self.low, self.high = np.minimum.reduceat(self.angles, self.begin), np.maximum.reduceat(self.angles, self.begin)

    def fitting(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Those of ``rows`` that no pivot keeps from what lies between ``low`` and ``high``."""
        a = self.angles[rows]
        return rows[((a >= low) & (a <= high)).all(axis=1)]


def _packs(inside: DataFrame, by: Column, dim: int) -> DataFrame:
    """One row for each value of ``by``: its vectors as bytes. ``inside``: id, u, cell, band, and perhaps label."""
    label = F.col("label") if "label" in inside.columns else F.lit(-1).cast("long").alias("label")

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cell, band = t.column("cell").to_numpy(), t.column("band").to_numpy()
        order = np.lexsort((band, cell))
        block = np.cumsum(np.append(0, (np.diff(cell[order]) != 0) | (np.diff(band[order]) != 0))).astype(np.int32)
        bytes_ = [t.column("id").to_numpy()[order].tobytes(), _matrix(t, dim)[order].tobytes(), block.tobytes(), t.column("label").to_numpy()[order].tobytes()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([x], pa.binary()) for x in bytes_]], names=["pack", "ids", "u", "block", "label"])

    rows = inside.select("id", "u", "cell", "band", label, by.cast("int").alias("pack")).where("id IS NOT NULL")
    parts = 4 * max(1, rows.select(F.max("pack")).first()[0] or 0)
    return stored(rows.repartition(parts, "pack").groupBy("pack").applyInArrow(pack, "pack int, ids binary, u binary, block binary, label binary"), "packs")


def _numbered(blocks: DataFrame, block: int) -> tuple[DataFrame, int]:
    """cell, band and pack of every block, and the number of packs: sixteen, or as many as ``PACK`` blocks each make."""
    found = blocks.orderBy("cell", "band").collect()  # a row for a block of vectors
    total = sum(r.n for r in found)
    packs = min(-(-total // block), max(PACK, -(-total // (PACK * block)))) or 1
    ends = np.cumsum([0, *[r.n for r in found]])
    rows = [(r.cell, r.band, int(e * packs // max(total, 1))) for r, e in zip(found, ends, strict=False)]
    return blocks.sparkSession.createDataFrame(rows, "cell int, band int, pack int"), packs


def _met(packs: DataFrame, pivots: np.ndarray, dim: int, run: Callable[[_Pack, _Pack, bool], Iterator[pa.RecordBatch]], schema: str, when: str = "true") -> DataFrame:
    """What ``run`` gives for every two packs. Packs are read again for each other one and never shuffled."""
    names = ["pack", "ids", "u", "block", "label"]
    a, b = (packs.select(*[F.col(c).alias(f"{c}_{t}") for c in names]) for t in "ab")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Pack] = {}

        def unpacked(batch: pa.RecordBatch, i: int, t: str, other: int) -> _Pack:
            k = batch.column(f"pack_{t}")[i].as_py()
            for gone in [x for x in known if x not in (k, other)]:
                del known[gone]
            if k not in known:
                ids, u, block, label = (np.frombuffer(batch.column(f"{c}_{t}")[i].as_buffer(), kind) for c, kind in zip(names[1:], (np.int64, np.float64, np.int32, np.int64), strict=True))
                known[k] = _Pack(ids, u.reshape(-1, dim), block, label, pivots)
            return known[k]

        for batch in batches:
            for i in range(batch.num_rows):
                x, y = batch.column("pack_a")[i].as_py(), batch.column("pack_b")[i].as_py()
                yield from run(unpacked(batch, i, "a", y), unpacked(batch, i, "b", x), x == y)

    return a.join(b, F.expr(f"pack_a <= pack_b AND ({when})")).mapInArrow(each, schema)


def _tiles(a: _Pack, b: _Pack, same: bool, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For every two blocks the rows of each that may have a neighbour in the other, and whether it is one block."""
    for i in range(len(a.begin)):
        for j in range(i if same else 0, len(b.begin)):
            if (a.low[i] > b.high[j] + reach).any() or (a.high[i] < b.low[j] - reach).any():
                continue
            x = a.fitting(np.arange(a.begin[i], a.end[i]), b.low[j] - reach, b.high[j] + reach)
            y = b.fitting(np.arange(b.begin[j], b.end[j]), a.low[i] - reach, a.high[i] + reach) if len(x) else x
            if len(y):
                yield x, y, same and i == j


def _reach(above: float) -> float:
    return float(np.arccos(np.clip(above, -1, 1))) + MARGIN


def _cells(src: np.ndarray, dst: np.ndarray, *sim: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.minimum(src, dst), pa.int64()), pa.array(np.maximum(src, dst), pa.int64()), *[pa.array(s, pa.float64()) for s in sim]]
    return pa.record_batch(arrays, names=["src", "dst", "sim"][: len(arrays)])


def edges(vectors: DataFrame, key: str, column: str, dim: int, above: float, block: int = BLOCK, cell: int = CELL, best: bool = False) -> DataFrame:
    """src < dst and their cosine above ``above`` (F6, F8, J3), of all pairs of usable vectors.

    Where several vectors have one key, two keys have an edge for each pair of their vectors, or with ``best`` the best one.
    """
    inside, blocks, pivots = placed(usable(vectors, key, column, dim), dim, block, cell)
    numbers, n = _numbered(blocks, block)
    reach = _reach(above)

    def multiply(a: _Pack, b: _Pack, same: bool) -> Iterator[pa.RecordBatch]:
        for left, right, own in _tiles(a, b, same, reach):
            for i in range(0, len(left), 1024):
                part = left[i : i + 1024]
                sims = a.u[part] @ b.u[right].T
                x, y = np.divmod(np.flatnonzero(sims > above), len(right))
                p, q = a.ids[part[x]], b.ids[right[y]]
                keep = p < q if own else p != q  # within a block each pair is met twice
                if keep.any():
                    yield _cells(p[keep], q[keep], sims[x, y][keep])

    def largest(a: _Pack, b: _Pack, same: bool) -> Iterator[pa.RecordBatch]:
        """All vectors of two keys meet in one pair of packs, and those of some of the left keys at a time."""
        order = np.argsort(a.ids, kind="stable")
        firsts = np.flatnonzero(np.append(True, np.diff(a.ids[order]) != 0))
        begin = 0
        while begin < a.n:
            later = firsts[firsts > begin]
            within = later[later <= begin + max(1, (1 << 22) // b.n)]
            end = int(within[-1]) if len(within) else int(later[0]) if len(later) else a.n
            end = a.n if a.n - begin <= max(1, (1 << 22) // b.n) else end
            rows, begin = order[begin:end], end
            out = []
            for j in range(len(b.begin)):
                left = a.fitting(rows, b.low[j] - reach, b.high[j] + reach)
                for i in range(0, len(left), 1024):
                    part = left[i : i + 1024]
                    sims = a.u[part] @ b.u[b.begin[j] : b.end[j]].T
                    x, y = np.nonzero(sims > above)
                    p, q = a.ids[part[x]], b.ids[b.begin[j] + y]
                    keep = p < q if same else p != q
                    out.append((p[keep], q[keep], sims[x, y][keep]))
            p, q, sim = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0),) * 3
            if len(p):
                by = np.lexsort((-sim, q, p))
                p, q, sim = p[by], q[by], sim[by]
                top = np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
                yield _cells(p[top], q[top], sim[top])

    packs = _packs(inside, F.pmod(F.xxhash64("id"), F.lit(n)), dim) if best else _packs(inside.join(F.broadcast(numbers), ["cell", "band"]), F.col("pack"), dim)
    dropped(inside, blocks)  # packs have the vectors
    return _met(packs, pivots, dim, largest if best else multiply, "src long, dst long, sim double")


def _joined(links: np.ndarray, n: int) -> np.ndarray:
    """For each of n things the smallest one that it reaches over the pairs of ``links``."""
    label = np.arange(n)
    while len(links):
        p, q = label[links[:, 0]], label[links[:, 1]]
        links, p, q = links[p != q], p[p != q], q[p != q]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    return label


def _stars(inside: DataFrame, dim: int, above: float, centres: int, most_rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """``inside`` with a label, and links (src, dst): vectors of one label from 0 on are connected by the links.

    In a round ``centres`` vectors, up to half of them with a label, meet all vectors that have none. Rounds go on while they
    take away a tenth of those. What is connected without a centre stays to be found.
    """
    spark, rng = inside.sparkSession, range(1, most_rounds + 1)
    roots: list[int] = []  # of each label the vector that its members are linked with
    merged: list[tuple[int, int]] = []  # labels that turned out to be connected
    driver_links: list[tuple[int, int]] = []
    left, labelled, links, many = inside.withColumn("label", F.lit(-1)), [], [], inside.count()
    for turn in rng:
        drawn = lambda rows, n: rows.select("id", "u", "label").orderBy(F.xxhash64("id", F.lit(turn)), "id").limit(n).collect() if n else []  # noqa: B023, E731  at most ``centres`` rows
        old = drawn(reduce(DataFrame.unionByName, [x.where("label >= 0") for x in labelled]), centres // 2) if labelled else []
        chosen = [*old, *drawn(left, centres - len(old))]
        m = np.array([r.u for r in chosen]).reshape(-1, dim)
        first = {r.label: i for i, r in reversed(list(enumerate(chosen))) if r.label >= 0}
        group = _joined(np.vstack([np.argwhere(np.triu(m @ m.T > above, 1)), *[[[first[r.label], i]] for i, r in enumerate(chosen) if r.label >= 0]]), len(chosen))
        label = np.zeros(len(chosen), np.int32)
        for i, r in enumerate(chosen):
            g = int(group[i])
            if g == i:
                label[i] = r.label if r.label >= 0 else len(roots)
                if r.label < 0:
                    roots.append(r.id)
            else:
                label[i] = label[g]
                if r.label >= 0 and r.label != label[g]:
                    merged.append((int(label[g]), r.label))
        given = spark.sparkContext.broadcast((m, label, np.array(roots, np.int64)))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            m, label, roots = given.value
            known = np.arange(len(roots))
            for b in batches:
                u, got, more = _matrix(b, dim), np.full(b.num_rows, -1, np.int32), set()
                for i in range(0, b.num_rows, 512):
                    x, y = np.divmod(np.flatnonzero(u[i : i + 512] @ m.T > above), len(m))
                    at = np.flatnonzero(np.append(True, np.diff(x) != 0)) if len(x) else np.zeros(0, np.int64)
                    got[i + x[at]] = label[y[at]]
                    p, q = known[got[i + x]], known[label[y]]
                    if (p != q).any():
                        new = np.unique(np.column_stack([p, q])[p != q], axis=0)
                        more |= set(map(tuple, new.tolist()))
                        known = _joined(np.vstack([new, np.column_stack([np.arange(len(known)), known])]), len(known))
                yield pa.record_batch([*(b.column(c) for c in ("id", "u", "cell", "band")), pa.array(got), pa.array(np.where(got < 0, 0, roots[got]), mask=got < 0), pa.nulls(b.num_rows, pa.int32())], names=TOLD)
                if more:
                    ends = np.array(sorted(more), np.int32)
                    yield pa.record_batch([pa.nulls(len(ends), t) for t in (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32())] + [pa.array(ends[:, 0]), pa.nulls(len(ends), pa.int64()), pa.array(ends[:, 1])], names=TOLD)

        told = stored(left.select("id", "u", "cell", "band").mapInArrow(run, "id long, u array<double>, cell int, band int, label int, root long, other int"), "stars")
        merged += [(r.label, r.other) for r in told.where("other IS NOT NULL").select("label", "other").distinct().collect()]  # labels, not vectors
        rows = told.where("other IS NULL").drop("other")
        labelled.append(rows.where("label >= 0"))
        links.append(labelled[-1].select(F.col("root").alias("src"), F.col("id").alias("dst")))
        left, before, many = rows.where("label < 0"), many, rows.where("label < 0").count()
        if not many or 10 * many > 9 * before:
            break
    same = _joined(np.array(merged, np.int64).reshape(-1, 2), len(roots))
    numbers = spark.createDataFrame([(i, int(x)) for i, x in enumerate(same)] or [], "label int, whole int")
    driver_links = [(roots[a], roots[b]) for a, b in merged]
    links.append(spark.createDataFrame(driver_links, "src long, dst long"))
    every = reduce(DataFrame.unionByName, [*labelled, left]).drop("root").join(F.broadcast(numbers), "label", "left")
    return every.select("id", "u", "cell", "band", F.coalesce("whole", "label").cast("long").alias("label")), reduce(DataFrame.unionByName, links)


def links(vectors: DataFrame, key: str, column: str, dim: int, above: float, block: int = BLOCK, cell: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """src < dst: edges with the same connected components as those of ``edges``, but few of them.

    What ``_stars`` puts under the most frequent label is not compared among itself; all other pairs are, with the bounds of
    the blocks, and a pair of packs passes on only what connects two of its sets. Keys are of one vector each.
    """
    inside, _, pivots = placed(usable(vectors, key, column, dim), dim, block, cell)
    labelled, stars = _stars(inside, dim, above, centres)
    sizes = labelled.groupBy("label").count().where("label >= 0").orderBy(F.desc("count"), "label").first()
    apart = F.col("label") != (sizes.label if sizes else -1)
    labelled = stored(labelled.where("id IS NOT NULL").withColumn("apart", apart | (F.col("label") < 0)), "labelled")
    rest, main = (labelled.where(c) for c in ("apart", "NOT apart"))
    numbers, n_rest = _numbered(rest.groupBy("cell", "band").agg(F.count("*").alias("n")), block)
    more, _ = _numbered(main.groupBy("cell", "band").agg(F.count("*").alias("n")), block)
    numbers = numbers.withColumn("apart", F.lit(True)).unionByName(more.select("cell", "band", (F.col("pack") + n_rest).alias("pack"), F.lit(False).alias("apart")))
    reach = _reach(above)

    def connect(a: _Pack, b: _Pack, same: bool) -> Iterator[pa.RecordBatch]:
        ids, known = (a.ids, a.label) if same else (np.concatenate([a.ids, b.ids]), np.concatenate([a.label, b.label]))
        shift, out = 0 if same else a.n, []
        _, first, at = np.unique(known, return_index=True, return_inverse=True)
        now = np.where(known < 0, np.arange(len(ids)), first[at])
        for left, right, _ in _tiles(a, b, same, reach):
            for i in range(0, len(left), 1024):
                part, other = left[i : i + 1024], now[shift + right]
                if (other == other[0]).all():
                    part = part[now[part] != other[0]]
                if not len(part):
                    continue
                mine = now[part]
                near = (a.u[part] @ b.u[right].T > above) & (mine[:, None] != other)
                x, y = np.divmod(np.flatnonzero(near), len(right))
                p, q = mine[x], other[y]
                while len(p):  # every set joins the smallest one that it touches
                    ends = np.unique(np.column_stack([np.maximum(p, q), np.minimum(p, q)]), axis=0)
                    ends = ends[np.append(True, np.diff(ends[:, 0]) != 0)]
                    out.append(ends)
                    to = np.arange(len(ids))
                    to[ends[:, 0]] = ends[:, 1]
                    while (to[to] != to).any():
                        to = to[to]
                    now, p, q = to[now], to[p], to[q]
                    p, q = p[p != q], q[p != q]
        if out:
            ends = np.concatenate(out)
            yield _cells(ids[ends[:, 0]], ids[ends[:, 1]])

    packs = _packs(labelled.join(F.broadcast(numbers), ["cell", "band", "apart"]), F.col("pack"), dim)
    found = stars.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst")
    return found.unionByName(_met(packs, pivots, dim, connect, "src long, dst long", f"pack_a < {n_rest}").where("src < dst"))


def products(vectors: DataFrame, key: str, column: str, dim: int, above: float, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """One row: vectors, and the pairs of them (each counted from both sides, with itself) that ``edges`` multiplies."""
    inside, blocks, pivots = placed(usable(vectors, key, column, dim), dim, block, cell)
    numbers, _ = _numbered(blocks, block)
    reach = _reach(above)

    def count(a: _Pack, b: _Pack, same: bool) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([sum(len(x) * len(y) * (1 if own else 2) for x, y, own in _tiles(a, b, same, reach))], pa.int64())], names=["n"])

    pairs = _met(_packs(inside.join(F.broadcast(numbers), ["cell", "band"]), F.col("pack"), dim), pivots, dim, count, "n long")
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).select(F.lit(inside.count()).alias("vectors"), "pairs")


def approximate_edges(vectors: DataFrame, key: str, column: str, dim: int, above: float, width: float = 0.5, tables: int = 8, seed: int = 1) -> DataFrame:
    """The edges that share a bucket of some random projection, with exact cosines; may miss some."""
    rows = usable(vectors, key, column, dim)
    # The filter may run after the projection, so the projection must bear any vector.
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-300))
    whole = F.when(F.size("v") == dim, F.transform("v", lambda x: x / norm)).otherwise(F.array_repeat(F.lit(1.0), dim))
    unit = rows.withColumn("u", array_to_vector(whole))
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    near = model.approxSimilarityJoin(unit, unit, float(np.sqrt(2 - 2 * above))).where("datasetA.id < datasetB.id")
    return near.select(F.col("datasetA.id").alias("src"), F.col("datasetB.id").alias("dst"), cosine(F.col("datasetA.v"), F.col("datasetB.v")).alias("sim")).where(F.col("sim") > above)


def best_of_parts(parts: DataFrame, column: str, dim: int, above: float, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """Src < dst and the best cosine above ``above`` of a part of one owner and a part of the other. ``parts``: owner, ``column``.

    Every part is kept from blocks that no part of it can reach. All parts of an owner are in one pack, so a pair of packs
    decides two owners. With ``above`` below 0 two owners without a positive cosine get 0.
    """
    found = edges(parts, "owner", column, dim, above, block, cell, best=True)
    return found.select("src", "dst", F.greatest("sim", F.lit(0.0)).alias("sim"))


def mean_vectors(words: DataFrame, vectors: DataFrame, whole: bool = False) -> DataFrame:
    """The mean of the vectors of a text's words with repeats. ``words``: id, word; ``vectors``: word, v.

    One row for each number of the result (id, pos, x), or with ``whole`` one for each text (id, vector). Words without a
    vector are left out; so are texts without any. A task adds up one vector for each text.
    """
    counted = words.groupBy("id", "word").agg(F.count("*").alias("n"))
    numbers = counted.join(vectors, "word").select("id", F.col("n").cast("double").alias("n"), array_to_vector(F.col("v").cast("array<double>")).alias("v"))
    means = numbers.groupBy("id").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("n"))).alias("vector"))
    return means if whole else means.select("id", F.posexplode("vector").alias("pos", "x"))
