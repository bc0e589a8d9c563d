"""op7: exponent, budgets, blocks."""

import math
from collections import Counter, defaultdict

import pytest

from tests.llm.fixtures import documents
from tracklens.llm import mixing as M


def rows(n=600):
    return [(i, "w " * (1 + i % 40), "big" if i % 3 else f"s{i % 5}") for i in range(n)]


@pytest.mark.parametrize("limit", [1.0, 2.0, 3.5, 100.0])
def test_repetition(spark, limit):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = M.mix(df, repeats=limit).collect()
    total = Counter()
    for _, t, s in data:
        total[s] += len(t.split())
    drawn, copies = Counter(), Counter()
    for r in got:
        drawn[r.source] += r.n_tokens
        copies[r.doc_id, r.epoch] += 1
    assert set(copies.values()) == {1}
    assert {i for i, e in copies if e == 0} == {r[0] for r in data}  # every document at least once
    top = max(total.values())
    a = M.exponent(spark.createDataFrame([(k, v) for k, v in total.items()], "src string, total long"), repeats=limit)
    least = 0.0 if limit >= top / min(total.values()) else 1 - math.log(limit) / math.log(top / min(total.values()))
    assert least - 1e-9 <= a <= least + 1e-6
    for s, t in total.items():
        goal = t**a * top ** (1 - a)
        assert goal - 40 <= drawn[s] <= goal + 1 and drawn[s] / t <= limit + 1e-9


def test_entropy(spark):
    shares = [1000, 100, 10]
    a = M.exponent(spark.createDataFrame([(str(i), t) for i, t in enumerate(shares)], "src string, total long"), entropy=0.8)
    h = lambda a: -sum((w := t**a / sum(x**a for x in shares)) * math.log(w) for t in shares)
    assert h(a) >= 0.8 * math.log(3) > h(a + 1e-5)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 100)
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    got = M.mix(df, repeats=None, entropy=0.99, budget=5000).collect()
    used = Counter()
    for r in got:
        used[r.source] += r.n_tokens
    assert 5000 - 40 * len(used) - 10 <= sum(used.values()) <= 5000
    key = defaultdict(set)
    for r in got:
        key[r.source, r.epoch, r.block].add(r.mix_key)
        assert 0 <= r.mix_key <= 1
    assert all(len(v) == 1 for v in key.values())
    assert [tuple(r) for r in sorted(M.mix(df, repeats=None, entropy=0.99, budget=5000).collect())] == [tuple(r) for r in sorted(got)]


def test_awkward(spark):
    df = documents(spark)
    got = M.mix(df).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in df.collect()}
    assert M.mix(documents(spark, empty=True)).count() == 0
    drawn = M.mixed_documents(df)
    assert drawn.columns == df.columns and drawn.count() >= df.count()
    assert M.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).count() == 1


def test_documents_are_drawn_by_rows(spark):
    """As many rows of a source as its draws, also without ids, with one id in two sources, and with repeated rows."""
    rows = [(None, f"w{i} " * 10, "a") for i in range(100)] + [(None, f"v{i} " * 10, "b") for i in range(10)]
    rows += [(i, f"u{i} " * 5, s) for i in range(30) for s in "ab"] + [(500, "again and again", "b")] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter((r.doc_id, r.source) for r in M.mix(df).collect())
    drawn = M.mixed_documents(df).collect()
    got = Counter((r.doc_id, r.source) for r in drawn)
    assert sum(got.values()) == sum(want.values()) and Counter(s for _, s in got.elements()) == Counter(s for _, s in want.elements())
    given = Counter(rows)
    assert all(given[tuple(r)] <= n <= 3 * given[tuple(r)] for r, n in Counter(map(tuple, drawn)).items()) and set(map(tuple, drawn)) == set(rows)
