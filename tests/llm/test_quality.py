"""op1: statistics against plain Python, estimates against numpy, verdicts."""

import math
import random
import re
from collections import Counter

import numpy as np

from tests.llm.fixtures import WORDS, documents
from tracklens.llm import quality as Q


def stats(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_statistics(spark):
    df = documents(spark)
    got = Q.judge(df).collect()
    assert len(got) == df.count()
    text = {}
    for r in df.collect():
        text.setdefault(r.doc_id, set()).add(stats(r.text))
    for r in got:
        row = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert row in text[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert Q.judge(documents(spark, empty=True)).count() == 0


def test_outliers(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randrange(60, 400))), "en", "a" if i % 3 else "b") for i in range(900)]
    junk = [(1000 + i, " ".join(f"{w}***" for w in r.choices(WORDS, k=100)), "en", "a") for i in range(60)]
    out = {x.doc_id: x.kept for x in Q.judge(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(out[i] for i in range(900)) >= 898 and not any(out[1000 + i] for i in range(60))


def vector(text):
    n, chars, symbols, dup, repeat = stats(text)
    lines = sum(bool(re.search("[^\x20\x09-\x0d]", x)) for x in (text or "").split("\n"))
    return [math.log1p(n), math.log((chars + 1) / (n + 1)), math.sqrt(symbols / max(n, 1)), math.sqrt(dup / max(lines, 1)), math.sqrt(repeat / max(n, 1))]


def mcd(x):
    """Centre and scatter of the rows of x by concentration from two starts."""
    floor = np.diag(np.square(Q.FLOOR))
    fit = lambda y: (y.mean(axis=0), Q.CONSISTENT * np.cov(y.T, bias=True) + floor)
    rounded = np.round(x, 2)
    middle = np.median(rounded, axis=0)
    spread = 1.4826 * np.median(np.abs(rounded - middle), axis=0)
    ends = []
    for centre, scatter in ((middle, Q.CONSISTENT * np.diag(spread**2) + floor), fit(x)):
        for _ in range(Q.STEPS):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            bins = np.maximum(Q.LOWEST, np.ceil(np.log(d + 1e-12) * Q.BINS_A_UNIT))
            centre, scatter = fit(x[np.array([(bins < b).sum() < Q.SHARE * len(x) for b in bins])])
        ends.append((np.linalg.slogdet(scatter)[1], centre, scatter))
    return min(ends, key=lambda e: e[0])[1:]


def verdicts(rows):
    """doc_id to kept, by numpy over gathered groups."""
    bad = {i: stats(t)[0] < 50 or 2 * stats(t)[4] > stats(t)[0] for i, t, _, _ in rows}
    x = {i: np.array(vector(t)) for i, t, _, _ in rows}
    of = lambda f: [x[r[0]] for r in rows if f(r) and not bad[r[0]]]
    kept = {}
    for lang, source in {r[2:] for r in rows}:
        centre = scatter = None
        for group in (of(lambda r: True), of(lambda r: r[2] == lang), of(lambda r: r[2:] == (lang, source))):  # noqa: B023
            if group:
                m, c = mcd(np.array(group))
                w = 1 if centre is None else len(group) / (len(group) + Q.PRIOR)
                centre, scatter = (m, c) if centre is None else (w * m + (1 - w) * centre, w * c + (1 - w) * scatter)
        for i in (r[0] for r in rows if r[2:] == (lang, source)):
            d = x[i] - centre
            kept[i] = not bad[i] and d @ np.linalg.inv(scatter) @ d <= Q.CUT
    return kept


def test_verdicts_as_by_numpy(spark):
    """Groups from one row to hundreds, with outliers, null languages and sources, and sources that write differently."""
    r = random.Random(8)
    rows = []
    for i in range(700):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "c", None])
        words = r.choices(WORDS, k=r.randrange(40, 200))
        if i % 12 == 0:
            words = [w + r.choice(["***", "$$", "x" * 30]) for w in words]
        if source == "b":
            words = [w + "longer" for w in words]
        rows.append((i, "\n".join(" ".join(words[j : j + 15]) for j in range(0, len(words), 15)), lang, source))
    rows += [(1000, rows[0][1], "xx", "only"), (1001, None, "en", "a"), (1002, "", None, None), (1003, "few words", "yy", "a")]
    want = verdicts(rows)
    got = {x.doc_id: x.kept for x in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == want and 20 < sum(not k for k in want.values()) < 400


def test_estimate_is_concentrated(spark):
    """The fitted centre ignores a fifth of far points and is the one that numpy finds."""
    g = np.random.default_rng(2)
    x = np.vstack([g.normal(0, 1, (800, Q.D)), g.normal(12, 1, (150, Q.D))])
    df = spark.createDataFrame([(*map(float, v), False, ["k"]) for v in x], ", ".join(f"x{i} double" for i in range(Q.D)) + ", base_failed boolean, keys array<string>")
    e = Q.estimates(df).first()
    assert np.abs(np.array(e["mean"])).max() < 0.2 and e["rows"] == 950
    centre, scatter = mcd(x)
    assert np.allclose(e["mean"], centre) and np.allclose(e["scatter"], Q.upper(scatter))


def test_constant():
    assert 0.9e-6 < Q.chi_squared_cut() < 1.1e-6
    assert Q.repeated("a b c a b c".encode().split()) == 6 and Q.repeated(b"a b".split()) == 0
