"""op9 against the same models in plain Python, and its accuracy on held-out labels."""

import math
import random
import zlib
from collections import Counter

from tests.llm.fixtures import WORDS, documents
from tracklens.llm import lmscore as L


def brute(rows, good):
    n, words, pairs = [0, 0], [Counter(), Counter()], [Counter(), Counter()]
    docs = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        p = list(zip(w, w[1:], strict=False))
        docs.append((i, w, p))
        for k in (0, 1) if i in good else (0,):
            n[k] += len(w)
            words[k].update(w)
            pairs[k].update(p)
    if not n[1]:
        n[1], words[1], pairs[1] = n[0], words[0], pairs[0]
    scale = [n[1] / n[0] if n[0] else 1.0, 1.0]
    out = {}
    for i, w, p in docs:
        loss = []
        for k in (1, 0):
            total = 0.0
            for j, x in enumerate(w):
                one = (words[k][x] * scale[k] + L.WORD_MASS / L.WORDS) / (n[k] * scale[k] + L.WORD_MASS)
                if j:
                    both = pairs[k][p[j - 1]] * scale[k]
                    one = (both + L.PAIR_MASS * one) / (max(words[k][w[j - 1]] * scale[k], both) + L.PAIR_MASS)
                total -= math.log(one)
            loss.append(total / len(w) if w else None)
        out.setdefault(i, set()).add((len(w), *(None if x is None else round(x, 4) for x in loss)))
    return out


def test_scores(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    labels = [(i, i % 2) for i in range(0, 50)] + [(None, 1), (7, None)]
    good = {i for i, q in labels if i is not None and q == 1 and zlib.crc32(str(i).encode()) % 3 != 1}
    want = brute(rows, good)
    got = L.cross_entropy_difference(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(r.n_tokens == n and (n == 0 and r.target_loss is None or n and abs(r.target_loss - a) < 2e-3 and abs(r.background_loss - b) < 2e-3) for n, a, b in want[r.doc_id])
        assert r.loss_difference is None or r.loss_difference == r.target_loss - r.background_loss


def test_separates_held_out(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(WORDS[:200] if i % 2 else WORDS[150:], k=60))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    out = {x.doc_id: x.loss_difference for x in L.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    unseen = [i for i in out if zlib.crc32(str(i).encode()) % 3 == 1]
    assert max(out[i] for i in unseen if i % 2) < min(out[i] for i in unseen if not i % 2)


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert L.cross_entropy_difference(documents(spark, empty=True), labels).count() == 0
    assert L.cross_entropy_difference(documents(spark), labels).count() == documents(spark).count()


def test_words_do_not_share_counts(spark):
    """More distinct words than any fixed table of 2^18: each loss is that of the word's own count."""
    rows = [(i, " ".join(f"v{i}x{j}" for j in range(5000))) for i in range(120)]
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    n, target = 5000 * 120, 5000
    out = L.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()

    def loss(word, pair, total):
        one = (word + L.WORD_MASS / L.WORDS) / (total + L.WORD_MASS)
        return -(math.log(one) + 4999 * math.log((pair + L.PAIR_MASS * one) / (word + L.PAIR_MASS))) / 5000

    assert zlib.crc32(b"0") % 3 != 1
    for r in out:
        assert abs(r.background_loss - loss(target / n, target / n, target)) < 1e-6
        assert abs(r.target_loss - (loss(1, 1, target) if r.doc_id == 0 else loss(0, 0, target))) < 1e-6
