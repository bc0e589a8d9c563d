"""op2 and op10 against plain Python over all windows."""

import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, texts
from tracklens.llm import anchors, debruijn, suffixes


def in_order(df):
    """Distinct documents in the order of the operators: doc_id (null first), then the hash that Spark gives the text."""
    rows = df.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64(F.col("text").cast("binary")), 1).alias("x")).distinct().collect()
    return sorted(((r.doc_id, r.text, r.x) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1] or ""))


def windows(text, k):
    w = (text or "").encode().split()
    return w, [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def deduplicated(df, window):
    """doc_id to the results of its texts, by plain Python."""
    seen, want = set(), {}
    for doc_id, text, _ in in_order(df):
        w, ws = windows(text, window)
        keep = [True] * len(w)
        for i, x in enumerate(ws):
            if x in seen:
                keep[i : i + window] = [False] * window
            seen.add(x)
        stay = [x for x, y in zip(w, keep, strict=True) if y]
        want.setdefault(doc_id, set()).add((len(w), len(w) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
    return want


def found_by(got):
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed, r.kept_sha256))
    return found


@pytest.mark.parametrize(("window", "k"), [(20, 8), (6, 3)])
def test_dedup(spark, window, k):
    df = documents(spark)
    got = debruijn.dedup(df, window, k).collect()
    assert len(got) == df.count()
    assert found_by(got) == deduplicated(df, window)


def far_ids(spark):
    """Ids at the ends of the longs, some on several rows, and many rows without one."""
    ids = [2**55 + 1, 2**55 + 2, 2**62 + 5, -(2**63), -(2**63) + 1, 2**63 - 1, 0]
    t = texts(3, 90)
    rows = [(ids[i % 7] if i % 3 else None, x) for i, x in enumerate(t)] + [(2**55 + 1, t[13]), (2**55 + 1, t[13]), (-(2**63), t[3]), (None, t[3])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_far_ids(spark):
    df = far_ids(spark)
    assert found_by(debruijn.dedup(df).collect()) == deduplicated(df, 20)
    got = {}
    for r in suffixes.repeated_passages(df).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_repeated))
    assert got == repeated(df, 50)


def test_unequal_words_with_equal_hashes_are_found(spark, monkeypatch):
    """With forged hashes under the first seed, verification sends all through the next one."""
    weak, tried = debruijn.window_hashes, []
    edges = debruijn.edges
    monkeypatch.setattr(debruijn, "window_hashes", lambda h, k, seed=1: weak(h, k, seed) & np.uint64(0x700000 if seed == 1 else 1) if seed < 3 else weak(h, k, seed))
    monkeypatch.setattr(debruijn, "edges", lambda *a: tried.append(a[-1]) or edges(*a))
    df = documents(spark)
    assert found_by(debruijn.dedup(df).collect()) == deduplicated(df, 20)
    assert tried == list(debruijn.SEEDS[:2])


def test_nonbranching_paths(spark):
    """A passage, part of which one more document shares: paths end where it enters and leaves."""
    w = [f"p{i}" for i in range(60)]
    rows = [(0, " ".join(["a"] * 3 + w + ["b"])), (1, " ".join(["c"] * 5 + w + ["d"])), (2, " ".join(["e", *w[10:50], "f"]))]
    paths = debruijn.repeated_paths(anchors.keyed(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {(r.doc, r.at, r.len, r.from_doc, r.from_at) for r in paths.collect()} == {(1, 5, 41, 0, 3), (2, 1, 21, 0, 13)}
    got = sorted((r.doc_id, r.start, r.n_words, r.copies) for r in debruijn.unitigs(paths).collect())
    assert got == [(0, 3, 29, 1), (0, 13, 40, 2), (0, 34, 29, 1)]
    assert {(r.doc, r.at) for r in debruijn.branching(paths, 20).collect()} == {(0, 3), (0, 63), (0, 13), (0, 53)}
    wrong = paths.withColumn("from_at", F.when(F.col("doc") == 2, F.col("from_at") + 1).otherwise(F.col("from_at")))
    rows = anchors.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert debruijn.unequal(rows, paths, 20).count() == 0
    assert [r.path for r in debruijn.unequal(rows, wrong, 20).collect()] == [r.path for r in paths.where("doc = 2").collect()]


def test_spans_name_equal_words(spark):
    df = documents(spark).where("doc_id < 100 AND doc_id <> 8").dropDuplicates(["doc_id"])
    words = {r.doc_id: r.text.split() for r in df.collect()}
    n = 0
    for r in debruijn.dedup(df).collect():
        for s in r.spans:
            n += 1
            assert words[r.doc_id][s.start : s.start + s.n_words] == words[s.from_doc_id][s.from_start : s.from_start + s.n_words]
            assert (s.from_doc_id, s.from_start) < (r.doc_id, s.start)
    assert n


def test_empty(spark):
    assert debruijn.dedup(documents(spark, empty=True)).count() == 0
    assert suffixes.repeated_passages(documents(spark, empty=True)).count() == 0


def repeated(df, least):
    """doc_id to the results of its texts with a repeated passage, by plain Python."""
    docs = in_order(df)
    count = {}
    for _, text, _ in docs:
        for x in windows(text, least)[1]:
            count[x] = count.get(x, 0) + 1
    want = {}
    for doc_id, text, _ in docs:
        w, ws = windows(text, least)
        covered = np.zeros(len(w), bool)
        for i, x in enumerate(ws):
            if count[x] > 1:
                covered[i : i + least] = True
        if covered.any():
            want.setdefault(doc_id, set()).add((len(w), int(covered.sum())))
    return want


@pytest.mark.parametrize(("least", "k"), [(50, 16), (20, 8)])
def test_passages(spark, least, k):
    df = documents(spark)
    got = {}
    for r in suffixes.repeated_passages(df, least, k).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_repeated))
    assert got == repeated(df, least)


def test_anchors_follow_the_words():
    r = np.random.default_rng(1)
    text = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    inner = text[100:180]
    a, b = anchors.anchors_of(text, 8, 20)[1], anchors.anchors_of(inner, 8, 20)[1]
    assert (a[100:161] - 100 == b).all()


def test_word_hash_is_xxh3():
    assert debruijn.hashed(b"a b")[0] == xxhash.xxh3_64_intdigest(b"a")


def branching(n):
    """Texts of a few recurring segments, which branch before and after every segment."""
    r = np.random.default_rng(11)
    segments = [" ".join(f"s{i}x{j}" for j in range(r.integers(10, 19))) for i in range(8)]
    return [" ".join(segments[i] for i in r.integers(0, 8, r.integers(6, 14))) for _ in range(n)]


def test_passages_that_branch_on_both_sides(spark):
    texts = branching(300)
    count = {}
    for t in texts:
        for x in windows(t, 50)[1]:
            count[x] = count.get(x, 0) + 1
    want = {}
    for i, t in enumerate(texts):
        w, ws = windows(t, 50)
        covered = np.zeros(len(w), bool)
        for j, x in enumerate(ws):
            covered[j : j + 50] |= count[x] > 1
        if covered.any():
            want[i] = int(covered.sum())
    got = suffixes.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeated for r in got} == want


@pytest.mark.parametrize("most", [1, 7, 40])
def test_a_long_run_in_pieces(most):
    """Windows are carried over the pieces of a run: the same spans however it is cut."""
    least, k = 50, 16
    rows = []
    for i, t in enumerate(branching(120)):
        h = suffixes.hashed(t.encode())
        runs, anchor = anchors.anchors_of(h, k, least)
        p = np.unique(anchor)
        if len(p):
            a, z = suffixes.sides(h, p, least, least - k)
            rows += [(int(runs[q]) >> 62, a[j].astype(">u4").tobytes(), a[j], z[j], i, 0, q, len(h)) for j, q in enumerate(p)]
    rows.sort(key=lambda x: x[:2])
    cols = [np.array([x[c] for x in rows]) for c in (0, 2, 3, 4, 5, 6, 7)]
    cols = [cols[0].astype(np.int64), cols[1], cols[2], cols[3].astype(np.int64), cols[4].astype(np.int64), cols[5].astype(np.int32), cols[6].astype(np.int32)]

    def covered(size, most):
        out = set()
        pieces = ([c[i : i + size] for c in cols] for i in range(0, len(rows), size))
        for m in suffixes.over_runs(pieces, least, most):
            for r in m.to_pylist():
                out.update((r["doc"], x) for x in range(r["start"], r["end"]))
        return out

    assert covered(5, most) == covered(len(rows), len(rows))
