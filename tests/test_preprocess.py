"""The preprocess query with its lemmas, and the SQL of the hidden Markov model against the tagger."""

import duckdb
import numpy as np
import pyarrow.parquet as pq

from tests.test_tagger import corpus
from tracklens import catalogue
from tracklens import model_sql as M
from tracklens.operators import tagger as G
from tracklens.plans.preprocess import preprocessed


def test_query_lemmatizes(spark, tmp_path):
    texts = {i: " ".join(ws) for i, ws in corpus(3, 300)}
    spark.createDataFrame([*texts.items(), (5000, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.issue_id: r.tokens.split() for r in catalogue.QUERIES["preprocess"](spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys() | {5000} and got[5000] == []
    every = {w for ws in got.values() for w in ws}
    assert "servers" not in every and "server" in every and "the" not in every and "." not in every
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {(i, t) for i, t in con.execute(f"SELECT issue_id, tokens FROM ({catalogue.ORACLES['preprocess']})").fetchall()} == {(i, " ".join(t)) for i, t in got.items()}


def test_rows_with_one_key_keep_their_own_tokens(spark):
    rows = [(1, "the servers crashed"), (1, "old clients"), (None, "a server"), (2, None)]
    got = preprocessed(spark.createDataFrame(rows, "issue_id long, summary string"), ["the"], "learned").collect()
    assert sorted((r.issue_id or 0, len(r.tokens)) for r in got) == [(0, 2), (1, 2), (1, 2), (2, 0)]
    assert {tuple(r.tokens) for r in got if r.issue_id is None} == {("a", "server")}


def test_sql_of_the_model(spark):
    texts = [*corpus(5, 80), (902, ["on", "the"] * 9), (903, ["walks"] * 13), (904, [])]
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (id BIGINT, tokens VARCHAR[])")
    con.executemany("INSERT INTO texts VALUES (?, ?)", texts)
    views = M.parts_of_speech("texts", G.HINTS, G.OTHERWISE, G.PRIOR, G.MORE, 3, G.GRAIN, block=4)
    run = lambda sql: con.execute("WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in views) + sql).fetchall()
    lists = spark.createDataFrame(texts, "id long, tokens array<string>")
    model = G.trained(lists, 3)
    [(start, move)] = run(" SELECT s, m FROM hmm_m3")
    assert np.allclose(start, model.start, atol=1e-9) and np.allclose(np.array(move).reshape(5, 5), model.move, atol=1e-9)
    got = {(i, p - 1): (w, G.STATES[s - 1]) for i, p, w, s in run(" SELECT * FROM hmm_tags")}
    assert got == {(r.id, r.pos): (r.word, r.tag) for r in G.tagged(lists, model).collect()}
    assert len(got) == sum(len(ws) for _, ws in texts)


def test_a_chunk_is_a_row_group(spark, monkeypatch):
    """Writer and reader hold a row group in memory, and a chunk is a row of many megabytes."""
    monkeypatch.setattr(G, "CHUNK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        laid = G.laid(spark.createDataFrame(corpus(4, 60), "id long, tokens array<string>").coalesce(1))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in laid.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) > 8
    assert all(f.metadata.row_group(i).num_rows == 1 for f in files for i in range(f.num_row_groups))
