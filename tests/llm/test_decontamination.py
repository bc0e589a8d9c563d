"""op5 against laying every item over every place."""

import random
import re
import time

from tests.llm.fixtures import WORDS, documents, texts
from tracklens.llm import decontamination as D


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def brute(docs, items):
    out = {}
    for i, t in docs:
        w = words(t)
        for k, q in items:
            q = words(q)
            n = len(q)
            if n < D.SHORTEST:
                continue
            for off in range(-n + 1, len(w)):
                same = [0 <= off + j < len(w) and w[off + j] == q[j] for j in range(n)]
                width = min(D.WINDOW, n)
                inside = max(sum(same[s : s + width]) for s in range(n - width + 1))
                if inside >= (n if n < D.WINDOW else D.LEAST):
                    a, b = out.get((i, k), (0, 0))
                    out[i, k] = max(a, inside), max(b, sum(same))
    return out


def test_overlaps(spark):
    r = random.Random(5)
    items = [(k, " ".join(r.choices(WORDS, k=n))) for k, n in enumerate([40, 15, 13, 12, 7, 6, 5, 4, 30])]
    items += [(20, None), (21, ""), (22, items[0][1])]
    docs = [(i, t) for i, t in enumerate(texts(3, 12))]
    for k, q in items[:9]:
        w = q.split()
        docs.append((100 + k, "Start " + " ".join(w) + ". End"))
        if len(w) >= 13:
            for spot in range(0, len(w) - 1, 6):
                w[spot] = "other"
            docs.append((200 + k, " ".join(w)))
            docs.append((300 + k, " ".join(w[2:])))
    docs += [(400, None), (401, "")]
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id): (x.window_matched, x.matched) for x in got.collect()} == brute(docs, items)


def test_masks_catch_two_substitutions():
    from itertools import combinations

    for gone in combinations(range(D.WINDOW), 2):
        assert any(all(o + p not in gone for p in m) for m in D.MASKS for o in range(D.WINDOW - m[-1]))


def test_awkward(spark):
    df = documents(spark)
    items = spark.createDataFrame([(1, df.where("doc_id = 3").first().text, "k"), (2, None, None)], "item_id long, text string, doc_id string")
    hit = {r.doc_id for r in D.overlaps(df, items).collect()}
    assert {3, None} <= hit
    left = D.decontaminated(df, items)
    assert left.columns == df.columns and not {3, None} & {r.doc_id for r in left.collect()}
    clean = spark.createDataFrame([(None, "nothing of an item here"), (None, "so " + items.first().text), (3, "as clean as can be")], "doc_id long, text string")
    assert [r.text for r in D.decontaminated(clean, items).orderBy("text").collect()] == ["as clean as can be", "nothing of an item here"]
    assert D.overlaps(documents(spark, empty=True), items).count() == 0 == D.overlaps(df, items.limit(0)).count()


def test_one_word_over_and_over(spark):
    """A text of one word hits everywhere: time in proportion to its length."""
    items = spark.createDataFrame([(1, "na " * 20)], "item_id long, text string")
    took = []
    for n in (4000, 8000, 16000, 32000):
        began = time.perf_counter()
        got = D.overlaps(spark.createDataFrame([(1, "na " * n)], "doc_id long, text string"), items).collect()
        took.append(time.perf_counter() - began)
        assert [(r.window_matched, r.matched) for r in got] == [(13, 20)]
    assert took[3] < 4 * took[1]
