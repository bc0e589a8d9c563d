"""What similarity leaves on disk."""

import numpy as np
import pytest

from tracklens.operators import similarity as S
from tracklens.sources.durable import _filesystem, shared_dir


@pytest.mark.parametrize("best", [False, True])
def test_vectors_are_kept_once(spark, best):
    def there():
        fs, where = _filesystem(spark, shared_dir(spark))
        return {f.getPath().getName() for f in fs.listStatus(where)}

    v = np.random.default_rng(1).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    before = there()
    found = S.edges(rows, "id", "v", 8, 0.3, block=16, cell=16, best=best)
    assert [n.split("-")[0] for n in there() - before] == ["packs"]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.3}
    assert {(r.src, r.dst) for r in found.collect()} == want
    assert found.count() == len(want)  # and again, from the packs
