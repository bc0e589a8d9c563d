"""The registered queries and the pipeline over the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline as P
from tests.llm import test_decontamination as D
from tests.llm import test_jaccard as J
from tests.llm import test_sharding as S
from tests.llm import test_toxicity as T
from tracklens.llm import registry, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF).select(*columns)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want.fetchall()))


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    docs = P.table(spark, SF, "documents")
    con = duckdb.connect()
    for t in ("benchmark",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    held_sql = next(q for n, q in registry.oracle_sql().items() if n.startswith("op5_"))
    labels, items = P.table(spark, SF, "labels"), [(r.item_id, r.text) for r in P.table(spark, SF, "benchmark").collect()]
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    for name, stage in P.STAGES:
        after = P.stored(stage(spark, docs, SF), name)
        rows = pairs(docs)
        if name == "toxicity":
            lexicon, curve = toxicity.model(docs, labels)
            score = lambda t: T.plain_score(t, lexicon, curve)  # noqa: B023, E731
            assert sorted(r[0] for r in pairs(after)) == sorted(i for i, t in rows if score(t) < toxicity.THRESHOLD)
        elif name == "ngram_jaccard":
            assert sorted(r[0] for r in pairs(after)) == sorted(i for i, c in J.brute(rows, 5, 80).items() if i == c)
        elif name == "decontamination":
            given = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
            con.register("documents", given)
            held = {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({held_sql})").fetchall()}
            some = [(i, t) for i, t in rows if i in held or i % 20 == 0]  # by every alignment: slow
            assert {i for i, _ in D.brute([(i, t) for i, t in some if len(t or "") < 20_000], items)} == {i for i, t in some if i in held and len(t or "") < 20_000}
            assert held and sorted(r[0] for r in pairs(after)) == sorted(i for i, _ in rows if i not in held)
        elif name == "mixing":
            assert_drawn(docs.collect(), Counter(r[0] for r in pairs(after)))
        if name != "sharding":
            assert after.columns == docs.columns
        else:
            order, first = S.groups(rows)
            begins = [order[c][0] for c in S.best([s for _, s in order], 16)]
            text = dict(rows)
            assert all(r.shard == sum(b <= first[text[r.doc_id]] for b in begins) for r in after.collect())
            assert after.count() == len(rows)
        docs = after


def test_decontamination_stage_against_sql(spark):
    docs = P.table(spark, SF, "documents")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = next(q for n, q in registry.oracle_sql().items() if n.startswith("op5_"))
    held = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql})").fetchall()}
    after = dict(P.STAGES)["decontamination"](spark, docs, SF)
    assert held and sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in held)


def assert_drawn(docs, drawn):
    """Budgets t ** a * largest ** (1 - a), with the least a that repeats no source more than twice."""
    size = {r.doc_id: len((r.text or "").split()) for r in docs}
    total = Counter()
    for r in docs:
        total[r.source] += size[r.doc_id]
    most, least = max(total.values()), min(total.values())
    a = max(0.0, 1 - math.log(2) / math.log(most / least))
    for source, t in total.items():
        goal = t**a * most ** (1 - a)
        own = [r.doc_id for r in docs if r.source == source]
        copies = {drawn[i] for i in own if size[i]}
        assert copies <= {int(goal / t + 1e-6), int(goal / t + 1e-6) + 1}
        assert goal * 1.001 + 1 >= sum(drawn[i] * size[i] for i in own) >= goal * 0.999 - max(size[i] for i in own) - 1


def awkward(spark, empty=False):
    """Null columns, empty and very long texts, repeated rows, and columns that clash with names that the stages use."""
    long = "word " * 30_000
    rows = [(i, f"some words of text {i} " * (5 + i), "en", "a" if i % 2 else None, i) for i in range(40)]
    rows += [rows[3], rows[3], (100, None, None, None, None), (101, "", None, "a", 0), (102, long, "en", "b", 1), (None, "no id at all", None, None, 2), (3, "another text of one id", "en", "a", 3)]
    names = ("_id", "_mark", "_n", "_i", "shard", "slot", "size", "mark", "n", "key")
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in names)
    return spark.createDataFrame([] if empty else [(*r, *["z"] * len(names)) for r in rows], schema)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_rows(spark, tmp_path, empty):
    docs = awkward(spark, empty)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        rows = P.table(spark, SF, name)
        (rows.limit(0) if empty else rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES:
        after = P.stored(stage(spark, at, str(tmp_path)), name)
        if name != "sharding":
            assert after.columns == docs.columns
        at = after
    assert (at.count() == 0) == empty
    if not empty:
        ids = {r.doc_id for r in at.collect()}
        assert {0, 1, 100, 101, 102, None} <= ids and {r.shard for r in at.collect()} <= set(range(16))
    assert P.run(spark, str(tmp_path)).count() == at.count()


def test_mixing_stage_draws_in_closed_form(spark):
    docs = P.table(spark, SF, "documents")
    drawn = Counter(r.doc_id for r in dict(P.STAGES)["mixing"](spark, docs, SF).collect())
    assert_drawn(docs.collect(), drawn)
