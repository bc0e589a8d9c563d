"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates (op1).

Each text becomes a vector of five transformed statistics. For each pair of language and source, for each language and
for all rows an MCD estimate of centre and scatter is fitted by concentration steps from two deterministic starts
(median with median deviations; mean with covariance): distances of all rows, their quantile at ``SHARE``, then mean
and covariance of the rows within it. The start with the smaller determinant wins. Every pair of language and source has
an estimate of its own at any size: centre and scatter of its n rows weigh n against ``PRIOR`` rows of its language's,
and these in turn n against ``PRIOR`` rows of all. A document is rejected if its squared Mahalanobis distance from its
pair's estimate exceeds ``CUT``.

Every step is one aggregation over all rows: a task adds up counts, sums and products for each bin of the distance, so
a hot source costs one row a bin and task in the shuffle, no group is ever gathered, and nothing goes to the driver.

Defined cases: a null or empty text has no words and fails the base rule; null languages and sources are groups of
their own; repeated rows are judged alike; an empty table gives an empty result; a statistic that is constant in a
group keeps the spread ``FLOOR``; a pair without any row that passes the base rules is its language's, a language
without one that of all; clashing extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import batches, dropped, id_and_text, stored, table, words_of

SYMBOLS = b"#*$%&|<>"
STEPS, SHARE = 5, 0.75
#: Rows of the coarser estimate that a finer one is shrunk with: ten for each statistic.
PRIOR = 50
#: Least spread of each transformed statistic: log words, log mean word length, roots of the shares of symbols, repeated lines, repeated words.
FLOOR = (0.5, 0.08, 0.05, 0.25, 0.25)
#: Chi-squared quantile of 5 degrees at 1 - 1e-6, and the factor that makes the covariance of the inner 75 % consistent.
CUT, CONSISTENT = 35.89, 1.41
D = len(FLOOR)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
#: Bins of log distance: deterministic quantiles from bounded counts.
BINS_A_UNIT, LOWEST = 16, -160

#: Estimates that may be broadcast: at most this many rows of about 300 bytes.
MOST_SENT = 100_000

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_stats(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = words_of(text)
    n = len(words)
    gaps = len(text) - sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return n, len(text.decode("utf-8", "replace")) - gaps, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words), len(lines)


def repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n + 2)
    m = len(ids)
    pair = a[:-1] * m + a[1:]
    if m >= 2_000_000:  # else three ids might not fit one number
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * m + a[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(n + 2, bool)
    for j in range(3):
        covered[j : j + n] |= twice
    return int(covered.sum())


def stats(docs: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, langs, sources, texts in batches(rows, "doc_id", "lang", "source", "text"):
            cols = list(zip(*map(text_stats, texts), strict=True))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(sources, pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=[x.split()[0] for x in STATS.split(", ")])

    return id_and_text(docs, F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(run, STATS)


def vectors(found: DataFrame) -> DataFrame:
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    x = [F.log1p("n_words"), F.log((F.col("word_chars") + 1) / (n + 1)), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n)]
    bad = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keys = [F.to_json(F.struct(F.lit(0).alias("level"), "lang", "source")), F.to_json(F.struct(F.lit(1).alias("level"), "lang")), F.lit('{"level":2}')]
    return found.select("*", bad.alias("base_failed"), *[v.alias(f"x{i}") for i, v in enumerate(x)], F.array(*keys).alias("keys"))


def _solved(sums: DataFrame) -> DataFrame:
    """From count, sums and products to centre, scatter, its inverse and its log determinant: a row for each estimate."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                mean = np.array([getattr(r, f"s{i}") for i in range(D)]) / r.n
                cov = np.zeros((D, D))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = getattr(r, f"p{i}{j}") / r.n - mean[i] * mean[j]
                cov = CONSISTENT * cov + np.diag(np.square(FLOOR))
                out.append((r.key, r.start, r.rows, mean.tolist(), upper(cov), upper(np.linalg.inv(cov)), float(np.linalg.slogdet(cov)[1])))
            yield pd.DataFrame(out, columns=["key", "start", "rows", "mean", "scatter", "inverse", "logdet"])

    return sums.mapInPandas(run, "key string, start int, rows long, mean array<double>, scatter array<double>, inverse array<double>, logdet double")


def upper(m: np.ndarray) -> list[float]:
    return m[tuple(zip(*PAIRS, strict=True))].tolist()


def shrunk(pairs: DataFrame, fitted: DataFrame) -> DataFrame:
    """pair, mean, inverse: the estimate of each pair, drawn towards its language's and that of all.

    ``pairs``: keys (pair, language, all).
    """
    for level in range(3):
        e = fitted.select(F.col("key").alias(f"k{level}"), F.struct("rows", "mean", "scatter").alias(f"e{level}"))
        pairs = pairs.withColumn(f"k{level}", F.col("keys")[level]).join(e, f"k{level}", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                mean, cov = None, None
                for e in (r.e2, r.e1, r.e0):
                    if e is not None:
                        share = 1.0 if mean is None else e["rows"] / (e["rows"] + PRIOR)
                        m, c = np.asarray(e["mean"], float), np.zeros((D, D))
                        for x, (i, j) in zip(e["scatter"], PAIRS, strict=True):
                            c[i, j] = c[j, i] = x
                        mean, cov = (m, c) if mean is None else (share * m + (1 - share) * mean, share * c + (1 - share) * cov)
                out.append((r.k0, mean.tolist(), upper(np.linalg.inv(cov))) if mean is not None else (r.k0, None, None))
            yield pd.DataFrame(out, columns=["pair", "mean", "inverse"])

    return pairs.select("k0", "e0", "e1", "e2").mapInPandas(run, "pair string, mean array<double>, inverse array<double>")


def distance():
    d = [F.col(f"x{i}") - F.col("mean")[i] for i in range(D)]
    return sum((d[i] * d[j] * F.col("inverse")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def estimates(vectors: DataFrame) -> DataFrame:
    """key, rows, mean, scatter: the MCD estimate of every group of each level."""
    x = [f"x{i}" for i in range(D)]
    rows = vectors.where("NOT base_failed").select(*x, F.explode("keys").alias("key"))
    adds = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"p{i}{j}") for i, j in PAIRS]]
    again = [F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(D)], *[F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in PAIRS]]
    # Medians and median deviations come from counts of rounded values: a bounded histogram for each group.
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.round(c, 2).alias("v")) for i, c in enumerate(x)]))
    shape = stored(rows.select("key", values.alias("s")).groupBy("key", "s.i", "s.v").agg(F.count("*").alias("n")), "mcd-counts")
    middle = shape.groupBy("key", "i").agg(F.sum("n").alias("rows"), F.percentile("v", 0.5, F.col("n")).alias("m"))
    off = shape.join(middle, ["key", "i"]).groupBy("key", "i").agg(F.first("rows").alias("rows"), F.first("m").alias("m"), F.percentile(F.abs(F.col("v") - F.col("m")), 0.5, F.col("n")).alias("d"))
    off = off.groupBy("key").agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(D) for c in "md"])
    spread = [F.pow(1.4826 * F.col(f"d{i}"), 2) * CONSISTENT + FLOOR[i] ** 2 for i in range(D)]
    robust = off.select("key", F.lit(0).alias("start"), "rows", F.array(*[F.col(f"m{i}") for i in range(D)]).alias("mean"), F.array(*[spread[i] if i == j else F.lit(0.0) for i, j in PAIRS]).alias("scatter"), F.array(*[1 / spread[i] if i == j else F.lit(0.0) for i, j in PAIRS]).alias("inverse"), F.lit(0.0).alias("logdet"))
    plain = _solved(rows.groupBy("key").agg(*adds).select(F.lit(1).alias("start"), F.col("n").alias("rows"), "*"))
    now = stored(robust.unionByName(plain), "mcd")
    few = now.count() <= MOST_SENT
    for _ in range(STEPS):
        bin_ = F.greatest(F.lit(LOWEST), F.ceil(F.log(distance() + 1e-12) * BINS_A_UNIT)).cast("int")
        near = rows.join(F.broadcast(now) if few else now, "key").select("key", "start", "rows", bin_.alias("bin"), *x)
        by_bin = near.groupBy("key", "start", "rows", "bin").agg(*adds)
        upto = F.expr("sum(n) OVER (PARTITION BY key, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        inner = by_bin.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < SHARE * F.col("rows"))
        step = stored(_solved(inner.groupBy("key", "start", "rows").agg(*again)), "mcd")
        dropped(now)
        now = step
    return now.groupBy("key").agg(F.max("rows").alias("rows"), F.min_by(F.struct("mean", "scatter"), F.struct("logdet", "start")).alias("e")).select("key", "rows", "e.mean", "e.scatter")


def judge(docs: DataFrame) -> DataFrame:
    """Every document with its statistics, ``base_failed`` and ``kept``."""
    v = stored(vectors(stats(docs)), "quality")
    fitted = stored(shrunk(v.select("keys").distinct(), estimates(v)), "mcd-best")
    sent = F.broadcast(fitted) if fitted.count() <= MOST_SENT else fitted
    out = v.join(sent, F.col("keys")[0] == F.col("pair"), "left")
    far = F.coalesce(distance() > CUT, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def chi_squared_cut() -> float:
    """P(chi-squared of 5 degrees > CUT), for the test of the constant."""
    t = math.sqrt(CUT / 2)
    return math.erfc(t) + math.exp(-CUT / 2) * math.sqrt(2 / math.pi) * (math.sqrt(CUT) + CUT**1.5 / 3)
