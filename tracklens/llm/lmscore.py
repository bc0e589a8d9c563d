"""LM scoring by cross-entropy difference (op9).

Two bigram models share one vocabulary: all words and word pairs of the corpus, known by 64-bit hashes. The target model
counts the documents labelled as good (quality 1) outside the held-out third, the background model counts all
documents. Both are matched: the background's counts are scaled to the number of tokens of the target, and one smoothing
(pairs backed off to words, words to a uniform share of 1 in ``WORDS``, by Dirichlet masses) serves both. A document's
score is the mean over its tokens of the target's loss minus the background's, in nats; the lower, the more it reads
like the target.

Every document is counted and every document is scored, whole. Documents are dealt to chunks of about ``CHUNK_BYTES``. A
chunk counts its distinct words and pairs and asks the owners of their hash ranges, who add up the counts of all chunks
and answer in the order of the question; then the chunk scores its documents. What is gathered, chunks and ranges all
grow with the input, and nothing is broadcast but the labels, up to ``MOST_LABELS`` rows; beyond they are joined by
shuffling.

Defined cases: a null or empty text has no tokens and null losses; without target documents both models are the
background; a document with several labels is a target if one is 1; repeated rows are counted and scored as they come;
an empty table gives an empty result; clashing extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import id_and_text, mixed, table, word_hashes

#: Smoothing: tokens of backed-off mass behind each history, and behind the word counts; words of the uniform share.
PAIR_MASS, WORD_MASS = 50.0, 2000.0
WORDS = 1 << 18
MOST_LABELS = 2_000_000
CHUNK_BYTES = 16 << 20

ASKED = "range int, chunk int, keys binary, counts binary, good binary, n_all long, n_good long"
ANSWER = "range int, chunk int, counts binary, good binary, n_all long, n_good long"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, loss_difference double"


def hashed(text: bytes | None) -> np.ndarray:
    return word_hashes(text.lower().split()) if text else np.zeros(0, np.uint64)


def word_bucket(h: np.ndarray) -> np.ndarray:
    """The key of each word: its whole hash."""
    return h


def pair_bucket(h: np.ndarray) -> np.ndarray:
    """The key of each two neighbouring words."""
    return mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def with_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, target: whether the document teaches the target model."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().where(~held_out()).withColumn("target", F.lit(True))
    if labels.count() <= MOST_LABELS:
        good = F.broadcast(good)
    return id_and_text(docs).join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def in_chunks(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with their chunk, and the number of chunks. ``rows``: doc_id, text, target."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-size // CHUNK_BYTES), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text", "target").repartition(n, "chunk"), n


class Tokens:
    """Words and pairs of some documents: distinct keys in order, and which of them stands at each token."""

    def __init__(self, texts: list[bytes | None]):
        hs = [hashed(t) for t in texts]
        self.size = np.array([len(h) for h in hs], np.int64)
        h = np.concatenate([np.zeros(0, np.uint64), *hs])
        self.n, self.at = len(h), np.cumsum(self.size) - self.size
        self.start = np.zeros(self.n, bool)
        self.start[self.at[self.size > 0]] = True
        self.keys, which = np.unique(np.concatenate([word_bucket(h), pair_bucket(h)[~self.start[1:]] if self.n else h]), return_inverse=True)
        self.word, self.pair = which[: self.n], which[self.n :]  # a pair stands at its second word

    def counts(self, of: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs, in the documents marked in ``of`` only if it is given."""
        if of is None:
            which = np.concatenate([self.word, self.pair])
        else:
            own = np.repeat(of, self.size)
            which = np.concatenate([self.word[own], self.pair[own[~self.start]]])
        return np.bincount(which, minlength=len(self.keys))


def packed(counts: np.ndarray) -> bytes:
    """In the narrowest of one, two, four or eight bytes a count, with that width in front."""
    t = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype(np.uint8)
    return bytes([t.itemsize]) + counts.astype(t).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def planes(keys: np.ndarray) -> bytes:
    """The keys of a range without their highest byte, which it fixes: first all lowest bytes, and so on."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(7, -1).T
    return out.view("<u8").ravel()


def edges(keys: np.ndarray, bits: int) -> list[int]:
    """Where each of the ``2 ** bits`` ranges (256 or more) begins in sorted keys, and the end."""
    return [*np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(keys)]


def losses(t: Tokens, counts: tuple[np.ndarray, np.ndarray], n: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each token under the target and the background, from counts of all and of target documents."""
    scale = n[1] / n[0] if n[0] and n[1] else 1.0
    models = (counts[1], 1.0, n[1]) if n[1] else (counts[0], 1.0, n[0]), (counts[0], scale, n[0])
    out = []
    for c, s, total in models:
        word = c[t.word] * s
        prob = (word + WORD_MASS / WORDS) / (total * s + WORD_MASS)
        pair = c[t.pair] * s
        second = np.flatnonzero(~t.start)
        prob[second] = (pair + PAIR_MASS * prob[second]) / (word[second - 1] + PAIR_MASS)
        out.append(-np.log(prob))
    return out[0], out[1]


def scored(rows: DataFrame) -> DataFrame:
    """``SCORES`` of doc_id, text, target."""
    dealt, n_chunks = in_chunks(rows)
    bits = max(8, (n_chunks - 1).bit_length())

    def ask(part: pa.Table) -> pa.Table:
        t = Tokens(part.column("text").to_pylist())
        good = part.column("target").to_numpy()
        counts, own, at = t.counts(), t.counts(good), edges(t.keys, bits)
        cut = list(zip(at, at[1:]))
        n = len(cut)
        chunk, n_good = part.column("chunk")[0].as_py(), int(t.size[good].sum())
        return pa.table([pa.array(range(n), pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([planes(t.keys[i:j]) for i, j in cut], pa.binary()), pa.array([packed(counts[i:j]) for i, j in cut], pa.binary()), pa.array([packed(own[i:j]) for i, j in cut], pa.binary()), pa.array([t.n] * n, pa.int64()), pa.array([n_good] * n, pa.int64())], names=[c.split()[0] for c in ASKED.split(", ")])

    def answer(part: pa.Table) -> pa.Table:
        raw = [from_planes(k) for k in part.column("keys").to_pylist()]
        _, which = np.unique(np.concatenate(raw), return_inverse=True)
        ends = np.cumsum([len(k) for k in raw])[:-1]
        out = []
        for name in ("counts", "good"):
            own = np.concatenate([unpacked(c) for c in part.column(name).to_pylist()])
            total = np.zeros(int(which.max()) + 1 if len(which) else 0, np.int64)
            np.add.at(total, which, own)
            out.append(pa.array([packed(c) for c in np.split(total[which], ends)], pa.binary()))
        # Every chunk asks every range, so each knows the tokens of all.
        n = [pa.array([sum(part.column(c).to_pylist())] * len(raw), pa.int64()) for c in ("n_all", "n_good")]
        return pa.table([part.column("range"), part.column("chunk"), *out, *n], names=[c.split()[0] for c in ANSWER.split(", ")])

    def score(part: pa.Table, answers: pa.Table) -> pa.Table:
        t = Tokens(part.column("text").to_pylist())
        answers = answers.sort_by("range")
        counts = tuple(np.concatenate([unpacked(c) for c in answers.column(name).to_pylist()]) for name in ("counts", "good"))
        each = losses(t, counts, tuple(answers.column(c)[0].as_py() for c in ("n_all", "n_good")))
        size = t.size.tolist()
        loss = [[float(x / k) if k else None for x, k in zip(np.add.reduceat(np.append(e, 0.0), t.at).tolist(), size, strict=True)] for e in each]
        diff = [None if x is None else x - y for x, y in zip(*loss, strict=True)]
        return pa.table([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(loss[0], pa.float64()), pa.array(loss[1], pa.float64()), pa.array(diff, pa.float64())], names=[c.split()[0] for c in SCORES.split(", ")])

    answers = dealt.groupBy("chunk").applyInArrow(ask, ASKED).repartition(1 << bits, "range").groupBy("range").applyInArrow(answer, ANSWER)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORES)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and loss_difference of every document."""
    return scored(with_target(docs, labels))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses to six places, so that they don't depend on the order of sums."""
    out = cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("target_loss", "background_loss", "loss_difference")])
