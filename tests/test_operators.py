"""Graphs, scores, ranks, sources, streams and slots."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens import schema
from tracklens.operators import clusters as C
from tracklens.operators import encoders, ranking
from tracklens.operators import similarity as S
from tracklens.operators.graph import star_forest
from tracklens.plans.disentangle import labelled_by_topic
from tracklens.plans.preprocess import preprocessed, trained_vectors
from tracklens.plans.reports import assignee_by_component
from tracklens.sources import issues as I
from tracklens.streaming.texts import term_counts, token_stream


def forest(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("pairs", [[], [(1, 2), (2, 3), (9, 9)], [(i, i + 1) for i in range(60)], [(random.Random(3).randint(0, 80), i) for i in range(80)]])
def test_components(spark, pairs):
    want = {k: v for k, v in forest([p for p in pairs if p[0] != p[1]]).items()}
    got = star_forest(spark.createDataFrame([*pairs, (None, 1), (1, None)], "src long, dst long")).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    vertices = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    assert {r.id: r.component for r in C.components(vertices, spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize(("pairs", "want"), [([(0, 0), (1, 1), (1, 1)], 1.0), ([(0, 0), (0, 1), (1, 0), (1, 1)], 0.0), ([(0, 5), (0, 5)], 1.0), ([], None)])
def test_nmi(spark, pairs, want):
    got = C.nmi(spark.createDataFrame(pairs, "truth int, prediction int")).first().nmi
    assert got == want or abs(got - want) < 1e-12
    if pairs:
        assert abs(C.nmi(spark.createDataFrame([p[::-1] for p in pairs], "truth int, prediction int")).first().nmi - want) < 1e-12


def test_ranks(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 9), (None, 1)], "k string, n int")
    assert [r.k for r in ranking.ranked(df, 2, F.desc("n"), F.asc("k")).collect()] == ["c", "a"]
    assert ranking.ranked(df, 20, F.desc("n"), F.asc("k"), first=16).count() == 0
    assert {r.k: r.n for r in ranking.frequency(df.select("k"), "k").collect()} == {"a": 1, "b": 1, "c": 1}


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [(r.src, r.dst) for r in S.edges(df, "id", "v", 2, 0.8).collect()] == [(1, 2)]
    assert [(r.src, r.dst) for r in S.approximate_edges(df, "id", "v", 2, 0.8).collect()] == [(1, 2)]
    assert S.edges(df.limit(0), "id", "v", 2, 0.8).count() == 0


def clustered_vectors(spark, groups=12, each=60, dim=24, spread=0.05, seed=4):
    """Tight groups, two copies of one vector a third of the time, and some without a group."""
    r = random.Random(seed)
    gauss = lambda s: [r.gauss(0, s) for _ in range(dim)]
    centres = [gauss(1) for _ in range(groups)]
    rows = [[x + y for x, y in zip(c, gauss(spread), strict=True)] for c in centres for _ in range(each)]
    rows += [rows[5]] * 150 + [gauss(1) for _ in range(40)] + [[-x for x in rows[5]]]
    return rows, spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>").repartition(5)


@pytest.mark.parametrize(("block", "cell", "above"), [(4096, 512, 0.8), (40, 60, 0.8), (40, 60, 0.2), (25, 30, -0.3), (7, 1000, 0.9)])
def test_edges_with_pivots_against_all_pairs(spark, block, cell, above):
    rows, df = clustered_vectors(spark)
    m = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(m @ m.T > above, 1))
    got = S.edges(df, "id", "v", 24, above, block, cell).select("src", "dst").collect()
    assert len(got) == len(a) and {(r.src, r.dst) for r in got} == set(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize(("block", "cell", "above"), [(4096, 512, 0.8), (40, 60, 0.8), (40, 60, 0.2), (25, 30, 0.97), (4096, 4096, -0.3)])
def test_links_have_the_components_of_all_edges(spark, block, cell, above):
    rows, df = clustered_vectors(spark, spread=0.3)
    r = random.Random(8)
    chain = [[*rows[0]]]  # a long path of small steps
    for _ in range(80):
        chain.append([x + r.gauss(0, 0.05) + (0.12 if i % 2 else -0.12) for i, x in enumerate(chain[-1])])
    rows = rows + chain
    df = spark.createDataFrame([(7 * i % 10_007, v) for i, v in enumerate(rows)], "id long, v array<double>").repartition(5)
    every, few = S.edges(df, "id", "v", 24, above, block, cell), S.links(df, "id", "v", 24, above, block, cell)
    want = forest([(e.src, e.dst) for e in every.collect()])
    assert {x.id: x.component for x in star_forest(few).collect()} == want and few.where("src >= dst").count() == 0


def test_vectors_are_not_shuffled_for_each_block(spark):
    """Pairs of packs meet in a join without an exchange, also where the best edge of two keys is asked for."""
    _, df = clustered_vectors(spark)
    for best in (False, True):
        assert "Exchange hashpartitioning" not in S.edges(df, "id", "v", 24, 0.8, 40, 60, best)._jdf.queryExecution().executedPlan().toString()


def test_links_do_not_shuffle_vectors_for_each_block(spark):
    """The links that all queries on components stand on."""
    _, df = clustered_vectors(spark)
    assert "Exchange hashpartitioning" not in S.links(df, "id", "v", 24, 0.8, 40, 60)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("centres", "above"), [(8, 0.8), (60, 0.6)])
def test_links_beyond_the_centres(spark, centres, above):
    rows, df = clustered_vectors(spark, spread=0.3)
    want = forest([(e.src, e.dst) for e in S.edges(df, "id", "v", 24, above, 100).collect()])
    assert {x.id: x.component for x in star_forest(S.links(df, "id", "v", 24, above, 100, 100, centres)).collect()} == want


def test_blocks_stay_small_and_products_are_spared(spark):
    rows, df = clustered_vectors(spark)
    inside, _, pivots = S.placed(S.usable(df, "id", "v", 24), 24, 40, 60)
    assert inside.count() == len(rows) and inside.groupBy("cell", "band").count().agg(F.max("count")).first()[0] <= 80 and len(pivots) == 16  # equal vectors too
    done = S.products(df, "id", "v", 24, 0.8, 40, 60).first()
    assert done.vectors == len(rows) and done.pairs < 0.35 * len(rows) ** 2
    assert S.products(df, "id", "v", 24, -1.0, 40, 60).first().pairs == len(rows) ** 2


def test_recall_of_approximate_edges(spark):
    """Of planted pairs around and above the threshold at least nine in ten are found, and nothing below it."""
    r = random.Random(6)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = []
    for i in range(150):
        v = unit([r.gauss(0, 1) for _ in range(32)])
        rows += [(2 * i, v), (2 * i + 1, unit([x + r.gauss(0, 0.06 + 0.0005 * i) for x in v]))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    exact = {(e.src, e.dst) for e in S.edges(df, "id", "v", 32, 0.85).collect()}
    near = {(e.src, e.dst) for e in S.approximate_edges(df, "id", "v", 32, 0.85).collect()}
    assert len(exact) > 80 and near <= exact and len(near) >= 0.9 * len(exact)


def test_mean_vectors(spark):
    words = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "z")], "id long, word string")
    vectors = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 3.0])], "word string, v array<double>")
    assert sorted(tuple(r) for r in S.mean_vectors(words, vectors).collect()) == [(1, 0, 2.0), (1, 1, 1.0)]
    assert [tuple(r) for r in S.mean_vectors(words, vectors, whole=True).collect()] == [(1, [2.0, 1.0])]


def test_preprocess(spark):
    issues = spark.createDataFrame([(1, "The cats ran 12 miles {noformat}raw cats{noformat} home"), (2, None), (3, "the")], "issue_id long, summary string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("ran", "run")], "word string, lemma string")
    vectors = spark.createDataFrame([("cat", [3.0, 0.0]), ("run", [0.0, 3.0])], "word string, v array<double>")
    got = {r.issue_id: r for r in preprocessed(issues, ["the"], lemmas, vectors).collect()}
    assert got[1].tokens == ["cat", "run", "miles", "home"] and list(got[1].vector) == [1.5, 1.5] and got[1].error is None
    assert got[2].tokens == [] == got[3].tokens and got[2].vector is None and got[2].cleaned == ""
    assert {r.issue_id: r.tokens for r in preprocessed(issues, ["the"]).collect()}[1] == ["cats", "ran", "miles", "home"]


def test_preprocess_with_learned_lemmas(spark):
    rows = [(i, "the servers crashed and the server walked on") for i in range(20)] + [(50, "crash the server, walk on"), (51, None), (52, "")]
    got = {r.issue_id: r.tokens for r in preprocessed(spark.createDataFrame(rows, "issue_id long, summary string"), ["the", "and", "on"], "learned").collect()}
    assert got[0] == ["server", "crash", "server", "walk"] and got[50] == ["crash", "server", ",", "walk"] and got[51] == [] == got[52]


def test_trained_vectors(spark):
    lists = spark.createDataFrame([(["a", "b", "c"] * 4,), (["b", "c"] * 3,)], "tokens array<string>")
    a, b = (sorted((r.word, tuple(r.v)) for r in trained_vectors(lists, 8, 5).collect()) for _ in range(2))
    assert a == b and [w for w, _ in a] == ["b", "c"] and all(len(v) == 8 for _, v in a)


def test_equal_rows_have_one_first_appearance(spark):
    issues = spark.createDataFrame([(f"A-{i}", "A", f"2020-01-01T00:0{i}:00.000+0000", f"dev{j}") for i in (1, 1, 2) for j in range(20)], "issue_key string, project string, create_time string, assignee string")
    parts = spark.createDataFrame([("A-1", "server"), ("A-2", "server")], "issue_key string, component string")
    points = assignee_by_component(issues, parts, "A").collect()
    assert points and all(sum(p.first_appearance for p in points if p.assignee == a) == 1 for a in {p.assignee for p in points})


def test_schemas(spark):
    rows = spark.createDataFrame([("7", "A-1", "x")], "Component string, ISSUE_KEY string, more string")
    out = I.conformed(rows, schema.ISSUE_COMPONENT)
    assert out.schema == schema.ISSUE_COMPONENT and [tuple(r) for r in out.collect()] == [("A-1", "7")]
    with pytest.raises(ValueError):
        I.conformed(rows, schema.EDGE)
    spark.sql("DROP TABLE IF EXISTS tracklens_test")
    for _ in range(2):
        I.saved(rows, schema.ISSUE_COMPONENT, "tracklens_test")
    assert spark.table("tracklens_test").count() == 2
    spark.sql("DROP TABLE tracklens_test")


def test_jdbc_options():
    got = I.jdbc_options("jdbc:x://h/issue", "t", "u", "p", key="id", high=9, parts=4, fetchsize="5")
    assert got == {"url": "jdbc:x://h/issue", "dbtable": "t", "user": "u", "password": "p", "fetchsize": "5", "partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "4"}
    assert "partitionColumn" not in I.jdbc_options("j", "t", "u", "p")


def test_jdbc_on_an_embedded_database(spark, tmp_path):
    """Written, read in four ranges, with columns and filters left to the database."""
    url, rows = f"jdbc:derby:{tmp_path}/issues;create=true", [(i, f"A-{i}", "ALPHA" if i % 3 else "BETA", None if i % 5 else f"text {i}") for i in range(100)]
    issues = spark.createDataFrame(rows, "issue_id long, issue_key string, project string, summary string")
    issues.write.format("jdbc").options(url=url, dbtable="ISSUE", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="issue_key VARCHAR(40), project VARCHAR(40)").save()
    table = I.jdbc_table(spark, url, "ISSUE", "", "", key="ISSUE_ID", low=0, high=100, parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert table.rdd.getNumPartitions() == 4 and sorted(map(tuple, table.collect())) == sorted(rows, key=lambda r: r[0])
    assert [r[0] for r in table.select(F.spark_partition_id()).distinct().orderBy(F.spark_partition_id()).collect()] == [0, 1, 2, 3]
    some = table.where("PROJECT = 'BETA' AND ISSUE_ID > 50").select("ISSUE_KEY")
    assert {r[0] for r in some.collect()} == {k for i, k, p, _ in rows if p == "BETA" and i > 50}
    plan = some._jdf.queryExecution().executedPlan().toString()  # what the database gets
    assert "*EqualTo(project,BETA)" in plan and "summary" not in plan
    schema_ = schema.T.StructType([f for f in schema.ISSUE if f.name in ("issue_id", "issue_key", "project", "summary")])
    named = I.jdbc_table(spark, url, "ISSUE", "", "", schema=schema_, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert named.columns == ["issue_id", "issue_key", "project", "summary"] and named.count() == 100


@pytest.mark.parametrize("parts", [1, 7])
def test_listing_in_order(spark, tmp_path, parts):
    """The part files in order are the listing of the original, clusters and their separators included."""
    r = random.Random(4)
    found = [(i, 0 if i < 40 else i - i % 4 if i < 80 else i) for i in range(90)]
    keys = {i: (f"A-{i}", f"summary {r.random()}") for i, _ in found}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        I.write_listing(spark.createDataFrame(found, "id long, component long"), spark.createDataFrame([(i, *k) for i, k in keys.items()], "issue_id long, issue_key string, summary string"), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    clusters = {}
    for i, c in found:
        clusters.setdefault(c, []).append(i)
    want = "".join("".join(f"{keys[i][0]}     {keys[i][1]}\n" for i in sorted(ids)) + "-" * 50 + "\n" for _, ids in sorted(clusters.items(), key=lambda x: (-len(x[1]), x[0])))
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in files) == want and (len(files) > 1) == (parts > 1)


def test_members(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, component long")
    assert sorted(tuple(r) for r in C.members(found, 2).collect()) == [(1, 2, 1), (1, 2, 2)]


def test_dense_matrix_in_splits(spark, tmp_path):
    """Lines keep their number when the file is read by many tasks."""
    n = 120
    (tmp_path / "m.csv").write_text("".join(",".join(str(float(i * n + j)) for j in range(n)) + "\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        cells = I.read_dense_matrix(spark, str(tmp_path / "m.csv"), -1.0)
        assert cells.count() == n * (n - 1) // 2 and cells.where(f"sim <> src * {n} + dst").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_labels(spark):
    found = spark.createDataFrame([(i, 0) for i in range(5)] + [(9, 9)], "id long, component long")
    terms = spark.createDataFrame([(0, "foo"), (1, "foo"), (2, "client")], "id long, term string")
    classes = spark.createDataFrame([("client", 1), ("default other", 12)], "component string, class_id int")
    top = C.top_terms(found, terms)
    assert [(r.term, r.rank) for r in top.orderBy("rank").collect()] == [("foo", 1), ("client", 2)]
    assert [tuple(r) for r in C.labels(found, top, classes).collect()] == [(0, 5, 1)]
    assert [tuple(r) for r in C.labels(found, top.where("term = 'foo'"), classes).collect()] == [(0, 5, 12)]


def test_components_are_whole_or_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    with pytest.raises(RuntimeError):
        star_forest(path, most_rounds=1)
    assert {r.component for r in star_forest(path).collect()} == {0}


def test_labels_by_the_first_topic(spark):
    found = spark.createDataFrame([(i, c) for c in (1, 2) for i in range(10 * c, 10 * c + 6)], "id long, component long")
    docs = found.select("component", "id", F.when(F.col("component") == 1, F.array(F.lit("client"), F.lit("stuff"))).otherwise(F.array(F.lit("other"))).alias("tokens"))
    classes = spark.createDataFrame([("client", 1), ("default other", 12)], "component string, class_id int")
    a, b = (sorted(tuple(r) for r in labelled_by_topic(found, docs, classes).collect()) for _ in range(2))
    assert a == b == [(1, 6, 1), (2, 6, 12)]


def test_sources(spark, tmp_path):
    issues = spark.createDataFrame([("A-1", "A"), ("a-2", "a"), ("AB-1", "AB")], "issue_key string, project string")
    assert I.issues_of_project(issues, "A").count() == 2 and I.issues_of_project(issues, "none").count() == 0
    assert I.issue_by_key(issues, "A-2").count() == 1 and I.issue_by_key(issues.union(issues), "A-2").count() == 0
    assert I.rows_of_prefix(issues, "a").count() == 3
    assert I.without_keys(issues, issues.limit(1)).count() == 2
    (tmp_path / "m.csv").write_text("0,0.9,0\n0.9,0,0.2\n0,0.2,0\n")
    assert [tuple(r) for r in I.read_dense_matrix(spark, str(tmp_path / "m.csv"), 0.1).orderBy("src").collect()] == [(0, 1, 0.9), (1, 2, 0.2)]
    edges = I.read_dense_matrix(spark, str(tmp_path / "m.csv"), 0.1)
    I.write_edges(edges, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    for _ in range(2):
        I.append_lines(issues.select("issue_key"), str(tmp_path / "lines"))
    assert sorted(I.read_stop_words(spark, str(tmp_path / "lines")))[:2] == ["A-1", "A-1"]


def test_encoder_and_lemmas(spark):
    df = spark.createDataFrame([(1, ["a", "bb"]), (2, [])], "id long, tokens array<string>")
    got = df.select("id", encoders.encoded(F.col("tokens"), lambda: lambda t: [float(len(x)) for x in t]).alias("v")).collect()
    assert {r.id: r.v for r in got} == {1: [1.0, 2.0], 2: None}
    words = spark.createDataFrame([(1, 0, "cats"), (1, 1, "run")], "id long, pos int, word string")
    lemmas = spark.createDataFrame([("cats", "cat")], "word string, lemma string")
    assert [r.word for r in encoders.lemmatized(words, lemmas).orderBy("pos").collect()] == ["cat", "run"]
    assert encoders.lemmatized(words) is words


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("A-1", "2020-01-01T00:00:00.000+0000", "The cat cat"), ("A-2", None, None)], "issue_key string, create_time string, summary string")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("tok", token_stream(source, ["the"]), "append"), ("cnt", term_counts(source, ["the"]), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert {r.issue_key: r.tokens for r in spark.table("tok").collect()} == {"A-1": ["cat", "cat"], "A-2": []}
    assert [(r.term, r.n) for r in spark.table("cnt").collect()] == [("cat", 2)]


def test_digest_encoder_against_plain_sums():
    """Exact means, also past the words that a worker keeps, in well under the time of a Python loop over 32 numbers for each word."""
    import hashlib
    import time

    def plain(tokens):
        sums = [0.0] * 32
        for t in tokens:
            sums = [a + b for a, b in zip(sums, known[t], strict=True)]
        return [x / len(tokens) for x in sums]

    r = random.Random(3)
    texts = [[f"w{r.randrange(3000)}é" for _ in range(n)] for n in (1, 7, 5000, 70_000)]
    known = {t: [int(c, 16) - 7.5 for c in hashlib.md5(t.encode()).hexdigest()] for ts in texts for t in ts}
    encode, begin = encoders.digest_encoder(), time.perf_counter()
    got = [encode(t) for t in texts]
    mid = time.perf_counter()
    assert got == [plain(t) for t in texts] and mid - begin < (time.perf_counter() - mid) / 2
    encode([f"x{i}" for i in range(100_001)])
    assert [encode(t) for t in texts] == got
