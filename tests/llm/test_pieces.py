import hashlib
import os
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm import fixtures
from tracklens.llm import pieces as S
from tracklens.llm.base import small_batches

MODEL = S.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def theirs():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def random_texts(n=3000, seed=1):
    r = random.Random(seed)
    some = " ▁▁  \n\n\t\x00aeinrtshABC.,-_/123é漢字🎉�　\xa0<>s|'́"
    return ["".join(r.choice(some) for _ in range(r.randrange(60))) for _ in range(n)] + ["<s> </s> <unk> <0x0A>", " ", "   ", "▁", "\n", "ab" * 3000, " " * 500, "漢" * 400]


def test_same_ids_and_text_as_the_library(theirs):
    own = S.pieces(MODEL)
    for t in random_texts():
        ids, n, text, good = own.run([t], theirs)[0]
        want = theirs.encode(t)
        assert ids == ",".join(map(str, want)) and n == len(want) and text == theirs.decode(want) and good


def test_parts_change_nothing(theirs):
    """A text merged as a whole has the ids of its parts, and no two families of characters are joined by a piece."""
    own = S.pieces(MODEL)
    for t in random_texts(300, 2):
        if t:
            whole = own.with_bytes(own.merged(S.MARK + t.replace(" ", S.MARK)))
            assert own.run([t])[0][0] == ",".join(map(str, whole))
    assert all(own.part.fullmatch(p) for p in own.ids)


def test_decoding_any_ids(theirs, spark):
    r = random.Random(4)
    lists = [[r.randrange(32_000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randrange(12))] for _ in range(500)]
    rows = S.decoded(spark.createDataFrame(list(enumerate([*lists, None])), "doc_id long, ids array<int>"), MODEL).collect()
    assert {r.doc_id: r.text for r in rows} == dict(enumerate([*map(theirs.decode, lists), ""]))


def test_awkward_rows(spark, theirs):
    docs = fixtures.documents(spark)
    with small_batches(spark, 7):
        got = S.encoded(docs, MODEL, ids=True).collect()
    assert len(got) == docs.count() and all(r.agrees for r in got)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((d.doc_id, len(x := theirs.encode(d.text or "")), sha(",".join(map(str, x))), sha(theirs.decode(x))) for d in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == want
    assert all(r.ids == theirs.encode(r.decoded) for r in got)
    assert S.encoded(fixtures.documents(spark, empty=True), MODEL).count() == 0


def test_the_order_of_scores_matters(theirs):
    """A wrong agenda gives other ids, so that equal ids mean something."""
    own = S.Pieces(MODEL)
    own.rank = {p: -r for p, r in own.rank.items()}  # the worst pair first
    texts = ["understanding", "", "x", "an international organisation", "x understanding"]
    want = [",".join(map(str, theirs.encode(t))) for t in texts]
    got = own.run(texts, theirs)
    assert [r[3] for r in got] == [r[0] == w for r, w in zip(got, want, strict=True)] and [r[3] for r in got][:3] == [False, True, True]


def test_kept_parts_go(theirs, monkeypatch):
    monkeypatch.setattr(S, "KEPT", 40)
    own, texts = S.Pieces(MODEL), random_texts(300, 5)
    for i in range(0, 300, 10):
        assert [r[0] for r in own.run(texts[i : i + 10], theirs)] == [",".join(map(str, theirs.encode(t))) for t in texts[i : i + 10]]
        assert all(len(p) <= S.LONGEST for p in own.now)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        S.Pieces(b"")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query(spark, theirs):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = S.op13_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) and all(r.agrees for r in got)
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, theirs.encode(docs[r.doc_id]))).encode()).hexdigest() for r in got)
