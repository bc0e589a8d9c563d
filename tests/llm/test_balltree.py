import hashlib
import math
import random

import numpy as np
import pytest

from tracklens.llm import balltree as B

SCHEMA = "vec_id long, embedding array<float>, id string, v int, cluster string, distance string"


def vectors(seed=1, n=900, dim=64):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    out = [(i, (centres[i % 12] + r.normal(size=dim) * (0.01 if i % 2 else 0.4)).astype(np.float32).tolist()) for i in range(n)]
    hot = out[5][1]
    out += [(10_000 + i, hot) for i in range(300)]  # a third are equal
    out += [out[3], out[3], (7, out[8][1]), (None, out[4][1]), (-5, [0.0] * dim)]
    return out


def bad(dim=64):
    one = [0.5] * dim
    return [(20_001, None), (20_002, []), (20_003, one[:-1]), (20_004, [*one, 0.5]), (20_005, [None, *one[1:]]), (20_006, [math.nan, *one[1:]]), (20_007, [-math.inf, *one[1:]]), (20_008, [3e38, *one[1:]])]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "i", 1, "c", "d") for x in rows], SCHEMA)


def brute(rows, k=8, rounds=10):
    """Plain integers throughout."""
    if not rows:
        return []
    v = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows]
    first = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in v)[:k]
    z = [x for _, x in first]
    points = np.array([x for _, x in v], object)

    def nearest():
        d = np.stack([((points - np.array(c, object)) ** 2).sum(axis=1) for c in z], axis=1)
        best = [min(range(len(z)), key=lambda j: (row[j], j)) for row in d]
        return best, [row[b] for row, b in zip(d, best, strict=True)]

    for _ in range(rounds):
        best, _ = nearest()
        for c in range(len(z)):
            own = [x for (_, x), b in zip(v, best, strict=True) if b == c]
            if own:
                z[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    best, d = nearest()
    return sorted(((i, b, x, sum(y for y, c in zip(d, best, strict=True) if c == b), sum(d), hashlib.sha256(",".join(map(str, z[b])).encode()).hexdigest()) for (i, _), b, x in zip(v, best, d, strict=True)), key=repr)


def got(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted(map(tuple, B.op12_ball_tree(spark, str(tmp_path)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_query_against_brute_force(spark, tmp_path):
    rows = vectors()
    assert got(spark, tmp_path, rows + bad()) == brute(rows)


def test_large_components(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [r.choice([-1, 1]) * r.random() * 60_000 for _ in range(64)]) for i in range(20)]
    assert got(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, tmp_path, n):
    assert got(spark, tmp_path, vectors(n=20)[:n] + bad()) == brute(vectors(n=20)[:n])


def test_ties_go_to_the_smaller_number():
    z = np.array([[2, 0], [0, 0], [2, 0]], np.int64)
    v = np.array([[1, 0]] * 50 + [[2, 5]] * 3, np.int64)
    t = B.tree(v)
    for _, mine, _ in B.assigned(t, v[t["order"]], z):
        assert (np.asarray(mine) == 0).all()


def test_balls_spare_distances():
    """Tight groups are assigned as balls; every vector is assigned once."""
    r = np.random.default_rng(1)
    centres = r.integers(-1000, 1000, (8, 64))
    v = np.repeat(centres, 400, axis=0) + r.integers(-3, 4, (3200, 64))
    t = B.tree(v)
    seen, single = 0, 0
    for at, _, exact in B.assigned(t, v[t["order"]], centres):
        n = len(at) if exact is not None else int((t["end"][at] - t["begin"][at]).sum())
        seen, single = seen + n, single + (n if exact is not None else 0)
    assert seen == 3200 and single < 640
    for begin, end, centre, radius, total in zip(t["begin"], t["end"], t["centre"], t["radius"], t["sum"], strict=True):
        mine = v[t["order"][begin:end]]
        assert (mine.sum(axis=0) == total).all() and np.sqrt(((mine - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
