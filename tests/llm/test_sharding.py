"""op8 against a plain minimax partition."""

import zlib
from collections import Counter

import duckdb
import pytest

from tests.llm.fixtures import documents
from tracklens.llm import oracles, sharding


def greedy(sizes, cap):
    cuts, load = [], 0
    for i, s in enumerate(sizes):
        if i and load + s > cap:
            cuts.append(i)
            load = 0
        load += s
    return cuts


def best(sizes, k):
    """Cuts of the smallest capacity; a group above an even share of what is left stands alone."""
    alone = set()
    while True:
        runs, run = [], []
        for i, s in enumerate(sizes):
            if i in alone:
                runs.append(run)
                run = []
            else:
                run.append(i)
        runs = [r for r in [*runs, run] if r]
        left, rest = k - len(alone), sum(sizes[i] for r in runs for i in r)
        if not runs or left <= 0:
            break
        top = max((sizes[i], -i) for r in runs for i in r)
        if top[0] * left <= rest or len(alone) >= k:
            break
        alone.add(-top[1])
    if len(runs) > k - len(alone):
        alone, runs = set(), [list(range(len(sizes)))]
    begins = set(alone) | {r[0] for r in runs}
    if runs:
        left = k - len(alone)
        cap = max(max(sizes[i] for r in runs for i in r), 1)
        while sum(len(greedy([sizes[i] for i in r], cap)) + 1 for r in runs) > left:
            cap += 1
        for r in runs:
            begins |= {r[c] for c in greedy([sizes[i] for i in r], cap)}
    cuts, n = sorted(begins)[1:], len(sizes)
    last = list(range(n - min(k, n) + 1, n))  # each shard that follows has a group left
    return [min(c, x) for c, x in zip([*cuts, *last[len(cuts) :]], last, strict=True)]


def groups(rows):
    first, size = {}, Counter()
    for i, t in rows:
        first[t] = min(first.get(t, i), i)
        size[t] += len((t or "").encode()) + 1
    merged = Counter()
    for t, i in first.items():
        merged[i] += size[t]
    return sorted(merged.items()), first


def check(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign_shards(df, k).collect()
    assert len(got) == len(rows)
    order, first = groups(rows)
    begins = [order[c][0] for c in best([s for _, s in order], k)]
    where = {i: sum(b <= f for b in begins) for i, f in ((i, first[t]) for i, t in rows)}
    assert {r.doc_id: r.shard for r in got} == where
    for s in range(k):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    text = dict(rows)
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)


@pytest.mark.parametrize("k", [1, 4, 16])
def test_minimax(spark, k):
    check(spark, [(i * 1000, t) for i, t in enumerate([*[f"{'x' * ((i * 37) % 90)}{i % 70}" for i in range(300)], None, "", "é"])], k)


def test_hot_group(spark):
    check(spark, [(i, "copy " * 40 if i % 3 == 0 else f"text {i} " * (i % 5)) for i in range(300)], 8)


@pytest.mark.parametrize("n", [3, 15, 16, 17, 40])
def test_no_shard_is_empty(spark, n):
    rows = [(i, f"{i:04d}") for i in range(n)]
    check(spark, rows, 16)
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 16)
    assert got.select("shard").distinct().count() == min(n, 16)


def test_far_ids(spark):
    ids = [-(2**63), -(2**63) + 1, -5, 0, 7, 2**62 + 5, 2**63 - 1]
    check(spark, [(x, f"text {x}" * (1 + i % 3)) for i, x in enumerate(ids)], 4)


@pytest.mark.parametrize("k", [1, 3, 8, 16, 40])
def test_sql_is_the_plain_minimax(k):
    """The SQL that the query is compared with, with huge groups, many of them, and few groups."""
    for rows in ([(i, "copy " * 40 if i % 3 == 0 else f"text {i} " * (i % 5)) for i in range(200)], [(i, "z" * (300 if i % 9 == 4 else 1 + i % 7) + str(i)) for i in range(60)], [(1, None), (2, ""), (5, "é")], []):
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        if rows:
            con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        got = {r[0]: r for r in con.execute(oracles.minimax(k)).fetchall()}
        order, first = groups(rows)
        begins = [order[c][0] for c in best([s for _, s in order], k)]
        assert {i: r[4] for i, r in got.items()} == {i: sum(b <= first[t] for b in begins) for i, t in rows}
        assert all(got[i][2] == zlib.crc32((t or "").encode()) for i, t in rows)


def test_split_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 4)
    monkeypatch.setattr(sharding, "SPLIT", 8)
    check(spark, [(i * i, "y" * (i % 23)  + str(i)) for i in range(200)], 5)


def test_awkward(spark, tmp_path):
    df = documents(spark)
    got = sharding.contract(sharding.assign_shards(df, 16)).collect()
    assert len(got) == df.count() and all(0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None for r in got)
    assert sharding.assign_shards(documents(spark, empty=True), 16).count() == 0
    # Rows that share a doc_id or have none are written once each, with one shard and slot a row.
    written = sharding.write_shards(df, str(tmp_path / "out"), 4)
    key = lambda rows: Counter((r.doc_id, r.text, r.lang) for r in rows)
    assert key(written.collect()) == key(df.collect()) and written.select("shard", "slot").distinct().count() == df.count()
    rows = [(7, "same")] * 4 + [(None, "none"), (None, "none"), (None, None)] + [(i, f"text {i}") for i in range(28)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.write_shards(few, str(tmp_path / "few"), 4).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
