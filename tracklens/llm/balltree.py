"""k-means over integer vectors, filtered by ball trees.

Each task turns its vectors into metric trees, one for every ``TREE`` vectors: a ball has a centre, a radius, a count and
an integer sum, and is halved between two far points until it holds ``LEAF`` vectors or only equal ones. The trees are
written once and stay where they are; a round sends the centroids (k times the dimension) to them. A ball whose centre is
nearer to one centroid than to every other by more than twice its radius belongs to it as a whole, by the triangle
inequality, and adds its sum and count; otherwise its halves are looked at, and in leaves every vector, with exact
integer distances and ties for the smaller number. A task adds up what it has before one aggregate over clusters, so no
key gathers rows; equal vectors make a ball of radius 0. Rounding is covered by a margin in the test.

Defined cases: vectors that are null, of another length, or with a component that is null, not finite, or of 2^17 and more
in absolute value (whose squared distances would not fit 64 bits) are left out. A repeated row counts as often as it is
there; an inertia beyond 64 bits raises. Rows without an id are kept, with the id taken as empty text in the hash. With fewer vectors than k there
are as many centroids as vectors; without vectors there is no row. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import small_batches, stored, table

TREE, LEAF = 4096, 32
MOST = 1 << 17  # of a component
#: Below this integers, sums of products are exact in doubles.
EXACT = 1 << 22


def kept(vectors: DataFrame, key: str, column: str, dim: int, scale: int = 1024) -> DataFrame:
    """id and v, floor(scale * x) for each component, of the vectors that are kept."""
    v = F.col(column).cast("array<double>")
    good = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < MOST)), F.lit(False))  # NaN isn't smaller
    whole = F.transform(F.when(good, v), lambda x: F.floor(x * scale).cast("long"))
    return vectors.where(good).select(F.col(key).cast("long").alias("id"), whole.alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id; of rows with one id the smaller vector."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in rows.orderBy(digest, "v").limit(k).select("v").collect()], np.int64)


def tree(v: np.ndarray) -> dict[str, np.ndarray]:
    """A tree over integer vectors: their order, and for each ball its begin, end, first child (0 for a leaf), centre, radius and sum."""
    order, balls, todo = np.arange(len(v)), [], [(0, len(v))]
    child, at = [], 0
    while at < len(todo):
        begin, end = todo[at]
        mine = v[order[begin:end]]
        total = mine.sum(axis=0)
        centre = total / len(mine)
        away = ((mine - centre) ** 2).sum(axis=1)
        radius = float(np.sqrt(away.max()))
        balls.append((begin, end, centre, radius if (mine != mine[0]).any() else 0.0, total))
        if len(mine) > LEAF and (mine != mine[0]).any():
            one = mine[away.argmax()].astype(float)
            to_one = ((mine - one) ** 2).sum(axis=1)
            other = mine[to_one.argmax()].astype(float)
            # Half of them go with the far point that they are nearer to.
            side = np.argsort(to_one - ((mine - other) ** 2).sum(axis=1), kind="stable")
            order[begin:end] = order[begin:end][side]
            middle = (begin + end) // 2
            child.append(len(todo))
            todo += [(begin, middle), (middle, end)]
        else:
            child.append(0)
        at += 1
    begins, ends, centres, radii, sums = zip(*balls, strict=True)
    return {"order": order, "begin": np.array(begins), "end": np.array(ends), "child": np.array(child), "centre": np.array(centres), "radius": np.array(radii), "sum": np.array(sums, np.int64)}


def squared(v: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to centroids."""
    if max(np.abs(v).max(initial=0), np.abs(z).max(initial=0)) < EXACT:
        a, b = v.astype(float), z.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(axis=1) for c in z], axis=1)


def assigned(t: dict[str, np.ndarray], v: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, int | np.ndarray, np.ndarray | None]]:
    """Of a tree over ``v`` (in the tree's order): whole balls with their cluster, and leaves' rows with the cluster of each.

    Yields (balls, clusters, None) for balls as a whole and (rows, clusters, distances) for single rows.
    """
    balls = np.array([0])
    while len(balls):
        d = np.sqrt(((t["centre"][balls][:, None, :] - z[None, :, :]) ** 2).sum(axis=2))
        best = d.argmin(axis=1)
        nearest = d[np.arange(len(balls)), best]
        d[np.arange(len(balls)), best] = np.inf
        # The distances and the radius are right to some 1e-14 of their size; a tie is never decided here.
        whole = nearest + 2 * t["radius"][balls] < d.min(axis=1) * (1 - 1e-9) - 1e-6
        if whole.any():
            yield balls[whole], best[whole], None
        rest = balls[~whole]
        first = t["child"][rest]
        leaves = rest[first == 0]
        if len(leaves):
            rows = np.concatenate([np.arange(b, e) for b, e in zip(t["begin"][leaves], t["end"][leaves], strict=True)])
            exact = squared(v[rows], z)
            mine = exact.argmin(axis=1)  # the first of equal ones
            yield rows, mine, exact[np.arange(len(rows)), mine]
        balls = np.concatenate([first[first > 0], first[first > 0] + 1])


PARTS = ("begin", "end", "child", "radius", "centre", "sum")
TREES = "ids array<long>, points binary, " + ", ".join(f"{p} binary" for p in PARTS)


def forest(rows: DataFrame, dim: int) -> DataFrame:
    """The rows (id, v) as trees: one for each Arrow batch."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy().reshape(-1, dim)
            t = tree(v)
            # The points need at most 28 bits.
            blobs = {"points": v[t["order"]].astype(np.int32), **{p: t[p] for p in PARTS}}
            columns = [pa.array([b.column("id").take(pa.array(t["order"])).to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in blobs.values())]
            yield pa.record_batch(columns, names=["ids", *blobs])

    return rows.select("id", "v").mapInArrow(build, TREES)


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    kinds = {"begin": np.int64, "end": np.int64, "child": np.int64, "radius": np.float64, "centre": np.float64, "sum": np.int64}
    for b in batches:
        for i in range(b.num_rows):
            get = lambda c, kind: np.frombuffer(b.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
            t = {p: get(p, kind) for p, kind in kinds.items()}
            t["centre"], t["sum"] = t["centre"].reshape(-1, dim), t["sum"].reshape(-1, dim)
            yield b.column("ids")[i].values, get("points", np.int32).astype(np.int64).reshape(-1, dim), t


def moved(trees: DataFrame, z: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of each cluster's mean, or what they were where the cluster is empty."""
    k, dim = z.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, v, t in _trees(batches, dim):
            for at, cluster, distance in assigned(t, v, z):
                np.add.at(counts, cluster, 1 if distance is not None else t["end"][at] - t["begin"][at])
                np.add.at(sums, cluster, v[at] if distance is not None else t["sum"][at])
        there = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(there, pa.int32()), pa.array(counts[there]), pa.array(list(sums[there]), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = trees.mapInArrow(run, "cluster int, n long, s array<long>")
    total = parts.select("cluster", "n", F.posexplode("s").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
    out = z.copy()
    for r in total.collect():  # k times the dimension
        out[r.cluster, r.pos] = r.s // r.n
    return out


def clustered(vectors: DataFrame, key: str, column: str, dim: int, k: int = 8, rounds: int = 10, seed: str = "3:", scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """id, cluster and distance (squared) of every kept vector after ``rounds`` rounds, and the centroids."""
    rows = kept(vectors, key, column, dim, scale)
    z = first_centroids(rows, k, seed)
    spark = vectors.sparkSession
    schema = "id long, cluster int, distance long"
    if not len(z):
        return spark.createDataFrame([], schema), z
    with small_batches(spark, TREE):
        trees = stored(forest(rows, dim), "trees")
    # A tree is a row of some 2 MB: few in an Arrow batch.
    with small_batches(spark, 8):
        for _ in range(rounds):
            z = moved(trees, z)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, v, t in _trees(batches, dim):
                cluster, distance = np.zeros(len(v), np.int32), np.zeros(len(v), np.int64)
                for at, mine, exact in assigned(t, v, z):
                    if exact is not None:
                        cluster[at], distance[at] = mine, exact
                        continue
                    for ball, c in zip(at.tolist(), mine.tolist(), strict=True):
                        own = slice(t["begin"][ball], t["end"][ball])
                        cluster[own], distance[own] = c, squared(v[own], z[c : c + 1])[:, 0]
                yield pa.record_batch([ids, pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

        out = stored(trees.mapInArrow(run, schema), "clustered")
    return out, z


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    rows, z = clustered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    own = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = [(c, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, z[c].tolist())).encode()).hexdigest()) for c in sorted(own)]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are sent


def oracle(dim: int = 64, k: int = 8, rounds: int = 10, seed: str = "3:", scale: int = 1024) -> str:
    """Every distance of every round, in whole numbers."""
    nearest = "SELECT row, c, v, d FROM (SELECT r.row, z.c, r.v, list_sum(list_transform(list_zip(r.v, z.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM rows_ r, {0} z) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c) = 1"
    steps = []
    for i in range(rounds):
        steps.append(f"near{i} AS MATERIALIZED ({nearest.format(f'z{i}')})")
        steps.append(f"means{i} AS MATERIALIZED (SELECT c, list(m ORDER BY pos) AS v FROM (SELECT c, pos, (s - ((s % n) + n) % n) // n AS m FROM (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {dim + 1})) AS pos FROM near{i}) GROUP BY 1, 2)) GROUP BY 1)")
        steps.append(f"z{i + 1} AS MATERIALIZED (SELECT z.c, coalesce(m.v, z.v) AS v FROM z{i} z LEFT JOIN means{i} m USING (c))")
    return f"""
WITH rows_ AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dim}),
z0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM rows_ ORDER BY h, v LIMIT {k})),
{", ".join(steps)},
last_ AS ({nearest.format(f"z{rounds}")})
SELECT vec_id, l.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM last_ l JOIN rows_ USING (row) JOIN z{rounds} z ON z.c = l.c"""
