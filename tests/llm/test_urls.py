"""op4: rules, host and path, digests with collisions, both ways of using the list."""

import numpy as np
import pytest

from tracklens.llm import urlfilter as U


def judged(spark, urls, **how):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, **how).collect()}


URLS = ["http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/", "https://example.com/EN/", "http://x.net/es/1", "http://net/fr/", "http://xnet/es/", "ftp://q.org", "no url", "", None, "http://spam-farm.example.org/a", "http://m.spam-farm.example.org?b", "http://my-spam-farm.example.org/a", "://h/p#f", "http://É.com/", "http://a://b/c"]


def test_rules(spark):
    got = judged(spark, URLS)
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("example.com", "/EN/", "com/", "allow")
    assert [got[i][2:] for i in (3, 4, 5)] == [("net/es/", "block"), ("net/fr/", "block"), (None, "allow")]
    assert [got[i] for i in (6, 7, 8, 9)] == [("q.org", "", None, "allow")] + [("", "", None, "allow")] * 3
    assert [got[i][3] for i in (10, 11, 12)] == ["block", "block", "allow"]
    assert got[13] == ("h", "/p", None, "allow") and got[14][0] == "É.com" and got[15][:2] == ("a:", "//b/c")


def test_joined_list_agrees(spark):
    blocked = [*U.BLOCKED, "q.org", "b.org/x/"]
    urls = [*URLS, "http://c.b.org/x/y", "http://b.org/y"] * 2
    assert judged(spark, urls, blocked=blocked) == judged(spark, urls, blocked=blocked, most_bytes=0)


@pytest.mark.parametrize("digest", [lambda b: 7, lambda b: len(b)])
def test_collisions(tmp_path, digest):
    for name, data in zip("ks", U.Digests.pack(["a", "bb", "cc", "dd"], digest), strict=True):
        (tmp_path / name).write_bytes(data)
    d = U.Digests(str(tmp_path / "k"), str(tmp_path / "s"))
    assert d.find([b"bb", b"dd", b"zz", b"a", b"b"], digest).tolist() == [True, True, False, True, False]
    assert isinstance(d.keys, np.memmap)


def test_empty(spark, tmp_path):
    assert judged(spark, []) == {} and judged(spark, ["http://a/"], blocked=[])[0][3] == "allow"


def test_list_from_a_table(spark, tmp_path):
    """A million entries from Parquet, sent out or joined; repeated, null and capital ones are no trouble."""
    path = str(tmp_path / "list")
    spark.range(1_000_000).selectExpr("concat('H', id, '.spam.example', if(id % 3 = 0, '/p/', '')) AS entry").unionByName(spark.createDataFrame([(None,), ("h1.spam.example",)], "entry string")).write.parquet(path)
    blocked = spark.read.parquet(path)
    urls = ["http://h1.spam.example", "http://x.H2.spam.example/q", "http://h3.spam.example/p/1", "http://h3.spam.example/q", "http://h1000000.spam.example", "http://spam.example", None] * 2
    want = ["block", "block", "block", "allow", "allow", "allow", "allow"] * 2
    for most in (64 << 20, U.MOST_BYTES):
        got = judged(spark, urls, blocked=blocked, most_bytes=most)
        assert [got[i][3] for i in range(14)] == want


def test_very_long_hosts(spark):
    """Only as many ends of a host are probed as the list has depths."""
    host = ".".join(["a"] * 200_000) + ".q.org"
    shape = U.Shape.of(["q.org", "b.c.org/x/"])
    assert len(U.candidates(host, "/" + "y" * 100_000, shape)) == 4
    assert judged(spark, [f"http://{host}/x", "http://" + "." * 100_000], blocked=["q.org"])[0][3] == "block"
