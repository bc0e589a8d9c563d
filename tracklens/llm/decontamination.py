"""Benchmark decontamination by spaced seeds (op5): DataFrame operations only.

Words are the runs of letters and digits of the lower-cased text. A seed is the hash of the six words that a mask leaves
of a few consecutive ones. The two masks together hit every stretch of ``WINDOW`` words with at most two substitutions,
at whatever positions; so does the first mask in a shorter item without one, and an item of five or six words is a
seed as a whole. Seeds of all documents are probed against those of the items, and around each hit the item is laid
over the document: it is found if some ``WINDOW`` consecutive words of it (or all of a shorter item) hold at least
``LEAST`` equal ones (or all). Hence the result doesn't depend on the masks: it is every such overlap. The hits of a
document are gathered to one list of places for each item, so its text is split once and the time grows with its words.

The items' seeds are sent to all executors only up to ``MOST_SEEDS`` rows; more are joined by shuffling, where AQE
splits a seed that many documents share. Documents that no seed hits are read once and never shuffled as words; texts
are shuffled once, to those with hits, by doc_id and a hash of the text.

Defined cases: null and empty texts and items hold no words and match nothing, nor do items of fewer than five words;
equal items are all reported; repeated and null doc_ids give one row with their best overlap, but of the documents
that share one only those that hold an item go; empty tables give an empty result; clashing extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh, stored, table

MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10))
WINDOW, LEAST, SHORTEST = 13, 11, 5
#: Seeds of items that may be broadcast: at most this many rows of four numbers, 64 MB.
MOST_SEEDS = 1_000_000


def word_array(text: str) -> Column:
    """Hashes of the words of a text, empty for null."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def seeds(words: str, masks) -> Column:
    """Seeds of all masks one after another; a mask that is longer than the text has none."""
    n = F.size(words)

    def of(k: int, mask) -> Column:
        span = mask[-1] + 1
        at = F.sequence(F.lit(0), n - span)
        return F.when(n >= span, F.transform(at, lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + p) for p in mask]))).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[of(k, m) for k, m in enumerate(masks)])


def found_at(masks) -> Column:
    """The place of a seed in the text, from its place in the array, its mask and the number of words."""
    start = F.col("pos")
    for k, m in enumerate(masks[:-1]):
        start = start - F.when(F.col("mask") > k, F.greatest(F.col("n") - m[-1], F.lit(0))).otherwise(0)
    return start


def _held(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), item_id, n_item, window_matched and matched of every document that holds an item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), word_array("text").alias("item")).where(F.size("item") >= SHORTEST)
    items = stored(items, "items")
    short = sorted(r[0] for r in items.where(F.size("item") < MASKS[0][-1] + 1).select(F.size("item")).distinct().collect())  # 5, 6 or none
    masks = (*MASKS, *[tuple(range(n)) for n in short])
    test = items.select("item_id", F.size("item").alias("n"), F.posexplode(seeds("item", masks)).alias("pos", "seed"))
    edges = [F.greatest(F.col("n") - m[-1], F.lit(0)) for m in masks]
    ends = [sum(edges[: k + 1], F.lit(0)) for k in range(len(masks))]
    mask = sum(((F.col("pos") >= e).cast("int") for e in ends[:-1]), F.lit(0))
    test = test.withColumn("mask", mask).select("seed", "item_id", "mask", found_at(masks).cast("int").alias("item_at"))
    # A whole short item is a seed only of its own length.
    test = stored(test, "item-seeds")
    few = test.count() <= MOST_SEEDS
    test, sent = (F.broadcast(test), F.broadcast(items)) if few else (test, items)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(), "text")
    probes = texts.select("doc_id", "mark", word_array("text").alias("words")).select("doc_id", "mark", F.size("words").alias("n"), F.posexplode(seeds("words", masks)).alias("pos", "seed"))
    hits = probes.join(test, "seed").select("doc_id", "mark", "item_id", (found_at(masks) - F.col("item_at")).cast("int").alias("offset"))
    # Of one document and item at most as many places as both have words.
    hits = stored(hits.groupBy("doc_id", "mark", "item_id").agg(F.collect_set("offset").alias("offsets")), "seed-hits")
    whole = hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("item_id", "offsets")).alias("hits"))
    laid = whole.join(texts, whole.doc_id.eqNullSafe(texts.doc_id) & (whole.mark == texts.mark)).select(whole.doc_id, whole.mark, "hits", word_array("text").alias("words"))
    laid = laid.select("doc_id", "mark", "words", F.explode("hits").alias("hit")).select("doc_id", "mark", "words", "hit.*").join(sent, "item_id").withColumn("n_item", F.size("item"))
    width = F.least(F.lit(WINDOW), F.col("n_item"))
    need = F.when(F.col("n_item") < WINDOW, F.col("n_item")).otherwise(LEAST)

    def at(offset: Column) -> Column:
        return F.transform("item", lambda w, j: F.when(F.when(offset + j >= 0, F.get("words", offset + j)) == w, 1).otherwise(0))

    def inside(same: Column) -> Column:
        return F.array_max(F.transform(F.sequence(F.lit(1), F.col("n_item") - width + 1), lambda i: F.aggregate(F.slice(same, i, width), F.lit(0), lambda a, x: a + x)))

    laid = laid.withColumn("same", F.transform("offsets", at))
    found = F.transform("same", lambda s: F.struct(inside(s).alias("window_matched"), F.aggregate(s, F.lit(0), lambda a, x: a + x).alias("matched")))
    laid = laid.withColumn("found", F.filter(found, lambda f: f["window_matched"] >= need)).where(F.size("found") > 0)
    best = [F.array_max(F.col(f"found.{c}")).alias(c) for c in ("window_matched", "matched")]
    return laid.select("doc_id", "mark", "item_id", "n_item", *best)


def mark() -> Column:
    """Tells the texts of one doc_id apart, and the documents without one."""
    return F.xxhash64("text").alias("mark")


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, window_matched and matched of every document that holds an item."""
    best = _held(docs, items).groupBy("doc_id", "item_id")
    return best.agg(F.first("n_item").alias("n_item"), F.max("window_matched").alias("window_matched"), F.max("matched").alias("matched"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    held_id, held_mark = fresh(docs, "held_id"), fresh(docs, "held_mark")
    held = _held(docs, items).select(F.col("doc_id").alias(held_id), F.col("mark").alias(held_mark)).distinct()
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col(held_id)) & (F.xxhash64("text") == F.col(held_mark)), "left_anti")


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """Every overlap by laying each item over each document wherever a word agrees."""
    words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, {words} AS w FROM documents)),
i AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) >= {SHORTEST}),
same AS (SELECT doc_id, item_id, n, d.p - i.p AS diagonal, i.p AS p FROM d JOIN i USING (w)),
much AS (SELECT doc_id, item_id, n, diagonal FROM same GROUP BY ALL HAVING count(*) >= least(n, {LEAST})),
run AS (SELECT same.*, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS inside
  FROM same JOIN much USING (doc_id, item_id, n, diagonal)),
laid AS (SELECT doc_id, item_id, n, diagonal, max(inside) AS inside, count(*) AS matched FROM run GROUP BY ALL)
SELECT doc_id, item_id, any_value(n)::INT AS n_item, max(inside)::INT AS window_matched, max(matched)::INT AS matched
FROM laid WHERE inside >= CASE WHEN n < {WINDOW} THEN n ELSE {LEAST} END GROUP BY doc_id, item_id"""
