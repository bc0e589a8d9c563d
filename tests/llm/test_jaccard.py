"""op3 against comparing all pairs."""

import random

import pytest

from tests.llm.fixtures import documents
from tracklens.llm import jaccard


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    """doc_id to its smallest reachable doc_id; rows of one doc_id are one document; rows without one are left out."""
    sets, up = {}, {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingles(t, n))
        up[i] = i

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_components(spark, n, percent):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute([r for r in rows if r[0] is not None], n, percent)
    got = jaccard.components(df, n, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted((repr(r.doc_id), r.n_shingles) for r in got) == sorted((repr(i), len(shingles(t, n))) for i, t in rows)
    # A row without an id takes part, behind all others.
    late = brute([(10**9 if i is None else i, t) for i, t in rows], n, percent)
    kept = [r.doc_id for r in jaccard.deduplicated(df, n, percent).collect()]
    assert sorted(map(repr, kept)) == sorted(repr(None if i == 10**9 else i) for i, c in late.items() if i == c)


def near_copies(n, away):
    """Copies of 200 words, each with ``away`` words of its own."""
    r = random.Random(n)
    base = [f"t{i}" for i in range(200)]
    return [(i, " ".join(f"u{i}x{j}" if j in set(r.sample(range(200), away)) else w for j, w in enumerate(base))) for i in range(n)]


def test_large_group_of_near_copies(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(base[: i % 190] + [f"u{i}"] + base[i % 190 + 1 :])) for i in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.components(df).collect()} == brute(rows, 3, 90)


def test_group_at_the_threshold(spark):
    """Only some copies link, through chains; no pair may be lost."""
    r = random.Random(5)
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(f"u{i}x{j}" if j in at else w for j, w in enumerate(base))) for i in range(120) for at in [set(r.sample(range(60), 3))]]
    want = brute(rows, 3, 90)
    assert 1 < len(set(want.values())) < 120
    assert {r.doc_id: r.component_id for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_pairs_grow_in_proportion(spark, monkeypatch):
    """Verified pairs of one group of near copies: as many a document in a larger group."""
    took = []
    of = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: took.append(pairs.count()) or of(pairs, *a))
    each = []
    for n in (300, 600, 1200):
        took.clear()
        rows = near_copies(n, 2)  # few pairs link, most of them in a chain
        got = {r.doc_id: r.component_id for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert sum(c == 0 for c in got.values()) > n / 2 and (n > 300 or got == brute(rows, 3, 90))
        each.append(sum(took) / n)
    assert each[2] < 1.3 * each[0] and max(each) < 4


def test_rows_without_words_and_id(spark):
    got = jaccard.components(spark.createDataFrame([(None, "a b c d"), (None, None), (3, None), (3, "a b c d"), (1, "a b c d")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (None, 1), (3, 1), (1, 1)}


def test_empty(spark):
    assert jaccard.components(documents(spark, empty=True)).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Repeated rows of one doc_id, rows without one, and a copy that is the only row with a doc_id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (5, a), (9, a + " more"), (None, a), (None, b), (None, b), (7, b + " end"), (None, c), (None, c), (None, None), (3, None), (-4, "short"), (4, "short")]
    df = spark.createDataFrame([(*r, "k", "r") for r in rows], "doc_id long, text string, key string, row string")
    got = jaccard.deduplicated(df)
    assert got.columns == df.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, [(5, a), (7, b + " end"), (None, c), (None, None), (3, None), (-4, "short")]))
    assert jaccard.deduplicated(df.limit(0)).count() == 0
