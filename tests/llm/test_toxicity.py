"""op6: folding, lexicon, held-out accuracy, bounds."""

import math
import random
import zlib

import pytest

from tests.llm.fixtures import WORDS, documents
from tracklens.llm import toxicity as T


@pytest.mark.parametrize(("word", "runs"), [("Idiot!", ["idiot"]), ("1d10t", ["idiot"]), ("іdіоt", ["idiot"]), ("m0r0n,", ["moron"]), ("ｌｏｓｅｒ", ["loser"]), ("2024", []), ("a-b", ["a", "b"]), ("$cum", ["scum"]), ("id\u200biot", ["idiot"])])
def test_fold(word, runs):
    assert T.fold(word) == runs


def plain_score(text, lexicon, curve):
    """The score by trying every entry at every place: the longest that begins there counts, then on behind it."""
    words = (text or "").split()
    folded, found, at = "".join(f" {x}{T.END}" for w in words for x in T.fold(w)), 0.0, 0
    by_start = {}
    for e in lexicon:
        by_start.setdefault(e[:2], []).append(e)
    while at < len(folded):
        here = [e for e in by_start.get(folded[at : at + 2], ()) if folded.startswith(e, at)]
        longest = max(here, key=len, default="")
        found += lexicon.get(longest, 0.0)
        at += len(longest) or 1
    z = curve[0] + curve[1] * math.log1p(100 * found / max(len(words), 20)) + curve[2] * math.log1p(found)
    return 1 / (1 + math.exp(-z))


def test_scores_by_plain_search(spark):
    rows, labels = corpus(300)
    rows += [(1000, "a trash can, you IDIOTS and idiot!"), (1001, None), (1002, "")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon, curve = T.model(docs, known)
    got = {r.doc_id: r.score for r in T.toxicity(docs, known).collect()}
    assert lexicon and all(abs(got[i] - plain_score(t, lexicon, curve)) < 1e-9 for i, t in rows)


def corpus(n=900):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [w.replace("w", "word").translate(str.maketrans("0123456789", "abcdefghij")) for w in r.choices(WORDS, k=r.randrange(20, 200))]
        if bad:
            for _ in range(max(2, len(words) // 40)):
                words[r.randrange(len(words))] = r.choice(["idiot", "1diot", "zorgelak", "zorgeltu", "zorgelmi", "Zorgeles"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus()
    out = T.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    unseen = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.99 * len(unseen)


def test_lexicon_learns_a_stem(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([(t, y) for (_, t), (_, y) in zip(rows, labels, strict=True)], "text string, toxic int")
    lexicon, sizes = T.learn(df)
    assert sizes == (150, 750)
    assert any(e.startswith(" zorgel") and len(e) <= 8 and w > 2 for e, w in lexicon.items())
    a = T.automaton(lexicon)
    assert T.total_weight(a, T.phrase("you idiot")) > 2 > T.total_weight(a, T.phrase("a trash can")) == 0


def test_level_of_evidence_is_chosen_without_the_held_out_third(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    level, other = (T.chosen(T.once(T.labelled(docs, spark.createDataFrame(y, "doc_id long, toxic int"), T.SAMPLE))) for y in (labels, flipped))
    assert level == other and level in T.LEVELS
    clean = spark.createDataFrame([(i, 0) for i, _ in labels], "doc_id long, toxic int")
    assert T.chosen(T.once(T.labelled(docs, clean, T.SAMPLE))) == T.CHANCE


def test_awkward(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (999, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    out = T.toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert T.toxicity(documents(spark, empty=True), labels).count() == 0
    assert T.toxicity(docs, labels.limit(0)).count() == docs.count()
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_only_copies_with_one_label_count_once(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    different = [" ".join(r.choices(words, k=600)) for _ in range(12)]  # of the same words
    near = different[0].upper() + "\n"
    rows = [(i, t, i % 2) for i, t in enumerate(different)] + [(50, different[0], 0), (51, near, 0), (52, different[0], 1), (60, None, 0), (61, "", 0), (62, "a b", 0)]
    kept = T.once(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).collect()
    assert sorted((x.doc_id, x.toxic) for x in kept) == [*((i, i % 2) for i in range(12)), (52, 1), (60, 0), (62, 0)]  # null and empty texts alike
