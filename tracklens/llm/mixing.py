"""Mixing sources to target weights by temperature (op7): DataFrame operations only.

A source with the token share p gets a weight in proportion to p ** alpha. The exponent is bisected (32 tries in one
aggregation, so five bits a round) to the largest one that still reaches a target entropy, or the smallest one that
keeps the repetition of any source within a limit. The budget is the least that holds every source whole at least
once, or a stated number of tokens. A source's budget is realised as permutations of its blocks: complete epochs, then
the first blocks of one more, of which the last is cut inside at the budget. ``mix_key`` runs from 0 to 1 along each
source's blocks, so that sorting by it interleaves the sources at their weights throughout.

A source has at most ``MOST_BLOCKS`` blocks and only the blocks at the cut are ordered row by row, so a source with a
third of all rows is dealt over many tasks. Only ids, sources and counts are shuffled, never texts.

Defined cases: a null source is a source of its own; null and empty texts count no tokens and follow their block; a
source without tokens, or an empty table, gives its rows once; repeated rows are rows of their own; clashing extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import WORD, fresh, numbered, stored, table

BLOCK_TOKENS, MOST_BLOCKS = 1 << 16, 4096
TRIES, ROUNDS = 32, 5


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, its key, n_tokens and the columns ``keep``."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("n_tokens"), *keep).withColumn("src", F.to_json(F.struct("source")))


def exponent(totals: DataFrame, repeats: float | None = None, entropy: float | None = None) -> float:
    """The exponent in [0, 1]. ``totals``: src, total > 0. ``entropy``: as a share of the logarithm of the number of sources."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        tries = [low + (high - low) * i / TRIES for i in range(TRIES + 1)]
        tried = totals.select(F.col("total").cast("double").alias("t"), F.explode(F.array(*map(F.lit, tries))).alias("a")).groupBy("a")
        if entropy is not None:
            # With weights w = t ** a and their sum W: H = ln W - sum(w ln w) / W.
            w = F.pow("t", F.col("a"))
            got = tried.agg((F.log(F.sum(w)) - F.sum(w * F.col("a") * F.log("t")) / F.sum(w)).alias("h"), F.count("*").alias("n"))
            ok = got.where(F.round(F.col("h"), 12) >= F.round(F.lit(entropy) * F.log("n"), 12)).agg(F.max("a")).first()[0]
            if ok is None or ok == high:
                return low if ok is None else high
            low, high = ok, tries[tries.index(ok) + 1]
        else:
            # Each source whole at least once: the repetition of one is (its total / the largest) ** (a - 1).
            got = tried.agg((F.max(F.log("t")) - F.min(F.log("t"))).alias("gap"))
            ok = got.where(F.round((1 - F.col("a")) * F.col("gap"), 12) <= F.round(F.log(F.lit(float(repeats))), 12)).agg(F.min("a")).first()[0]
            if ok is None or ok == low:
                return high if ok is None else low
            low, high = tries[tries.index(ok) - 1], ok
    return low if entropy is not None else high


def mix(docs: DataFrame, repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each time that a document is drawn: doc_id, source, n_tokens, epoch, block, mix_key and the columns ``keep``."""
    rows = stored(tokens(docs, *keep), "mix-rows")
    totals = stored(rows.groupBy("src").agg(F.sum("n_tokens").alias("total")), "mix-totals")
    live = totals.where("total > 0")
    a = exponent(live, repeats, entropy)
    scale = live.agg(F.sum(F.pow(F.col("total").cast("double"), F.lit(a))).alias("w"), F.max(F.pow(F.col("total").cast("double"), F.lit(1 - a))).alias("least")).first()
    # Weight q = t ** a / w; the least budget with q * budget >= t for all is w * max(t ** (1 - a)).
    per_weight = (budget / scale.w if budget is not None else scale.least) if scale.w else 0.0
    share = F.pow(F.col("total").cast("double"), F.lit(a)) * F.lit(float(per_weight))
    plan = totals.select(
        "src", "total",
        F.when(F.col("total") > 0, F.floor(F.round(share, 3)).cast("long")).otherwise(0).alias("goal"),
        F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_TOKENS))).cast("long").alias("k"),
    ).withColumn("whole", F.when(F.col("total") > 0, F.expr("goal div greatest(total, 1)")).otherwise(1))
    # Skew of the hot source is harmless: one row a source on this side, and AQE splits the other.
    dealt = rows.join(plan.select("src", "k"), "src").select("doc_id", "source", "src", "n_tokens", *keep, F.pmod(F.xxhash64("doc_id", F.lit(seed)), "k").alias("block"))
    dealt = stored(dealt, "mix-dealt")
    blocks = dealt.groupBy("src", "block").agg(F.sum("n_tokens").alias("size"))
    turns = blocks.join(plan, "src").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("epoch"))
    before = F.coalesce(F.expr("sum(size) OVER (PARTITION BY src, epoch ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    placed = turns.withColumn("turn", F.xxhash64("src", "block", "epoch", F.lit(seed))).withColumn("at", before + F.col("epoch") * F.col("total"))
    placed = placed.where((F.col("at") < F.col("goal")) | ((F.col("epoch") < F.col("whole")) & (F.col("goal") == 0)) | ((F.col("size") == 0) & (F.col("epoch") == 0)))
    placed = placed.select("src", "block", "epoch", "at", "goal", ((F.col("epoch") >= F.col("whole")) & (F.col("at") + F.col("size") > F.col("goal"))).alias("cut"), F.round(F.col("at") / F.greatest("goal", F.lit(1)), 9).alias("mix_key"))
    placed = stored(placed, "mix-blocks")
    keys = ["src", "block"]
    out = ["doc_id", "source", "n_tokens", "epoch", "block", "mix_key", *keep]
    full = dealt.join(placed.where("NOT cut"), keys).select(*out)
    upto = F.expr("sum(n_tokens) OVER (PARTITION BY src, block ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING)")
    part = dealt.join(placed.where("cut"), keys).withColumn("turn", F.xxhash64("doc_id", "epoch", F.lit(seed))).withColumn("upto", upto)
    return full.unionByName(part.where(F.col("at") + F.col("upto") <= F.col("goal")).select(*out))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents as often as they are drawn, with their own columns; draws count for rows, whatever their doc_id is."""
    rows, row = numbered(docs, "mix-documents")
    drawn = fresh(rows, "drawn")
    draws = mix(rows, keep=(row,), **how).select(F.col(row).alias(drawn))
    return rows.join(draws, F.col(row) == F.col(drawn)).select(*docs.columns)


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
