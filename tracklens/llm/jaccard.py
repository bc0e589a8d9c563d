"""N-gram Jaccard join (op3): rare-first prefix filtering, length, positional and suffix filters, exact verification.

A document's set holds the 64-bit hashes of its distinct word n-grams. Equal sets are one class, and only the class's
smallest doc_id goes on. N-grams are ordered rare first, by counts over all documents in ``BUCKETS`` buckets and then by
hash; any order that all documents share gives the exact join, the counts only make it short. Two sets that link share
one of their first n - ceil(t n) + 1 n-grams, and it is among the first n - ceil(2 t n / (1 + t)) + 1 of the smaller set.
Where two sets meet at such an n-gram, the lengths and the two positions bound the overlap that is possible, and the
suffix filter bounds the difference from below: each set carries the parities of its n-grams in ``64 * LANES`` cells, and
cells of different parity are different n-grams.

What remains is verified once per pair on the full sets. At a place of up to ``SMALL`` members all pairs meet, at most
half as many for each row. To lose no link without making all pairs of a larger group, its place compares the members
with one of them, at random for each place and turn; a document verifies the partner that its parities put nearest, and
what links is contracted to components. Turns go on while they shorten what is left. Then all members outside a larger
place's main component meet everything there that is not yet in their component and that the bounds leave. From these
pairs and those of the small places ``NEAREST`` times the nearest pair of every component is verified and contracted,
then all pairs that are still apart. So every pair is linked, filtered out by a proven bound, verified, or already known
to be connected.

Defined cases: null and empty texts have empty sets and link with nothing; a text of fewer than n words has its whole
sequence as its one element; equal texts link; rows with one doc_id are one document, whose every text links for it;
rows without a doc_id have no component; an empty table gives an empty result; clashing extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklens.operators.graph import star_forest

from .base import dropped, fresh, id_and_text, signed, small_batches, stored, table, window_hashes, word_hashes
from .counts import dense_counts

BUCKETS = 1 << 20
LANES = 8
#: Ids of documents to verify that may be broadcast: at most this many longs, 0.8 MB; more are joined by shuffling. Pairs with
#: their components are four longs, so a quarter as many are sent.
MOST_IDS = 100_000
#: Documents whose component may be broadcast: at most this many pairs of longs, 0.8 MB.
MOST_KNOWN = 50_000
NEAREST, SMALL = 3, 16
#: Below this stand the numbers that rows without a doc_id get in ``deduplicated``.
LAST = -(1 << 62)
SIG = [f"s{i}" for i in range(LANES)]
PAIR = ["a", "b", "left", "right"]


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the n-grams of the lower-cased words."""
    h = word_hashes(text.lower().split()) if text else np.zeros(0, np.uint64)
    if len(h) == 0:
        return h
    return np.unique(window_hashes(h, n) if len(h) >= n else window_hashes(h, len(h), seed=99))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """``LANES`` 64-bit words: the parity of the number of elements in each cell."""
    odd = np.bincount((s & np.uint64(64 * LANES - 1)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def needed(a: str, b: str, percent: int) -> Column:
    """The least intersection of two sets of these sizes that link: p (a + b) / (100 + p), rounded up."""
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, prefix (rare first) and suffix-filter parities of every row."""
    rows = id_and_text(docs)

    def add(b: pa.RecordBatch, out: np.ndarray) -> None:
        for t in b.column(1).to_pylist():
            s = shingles(t, n)
            if len(s):
                np.add.at(out[0], bucket(s), 1)

    often = docs.sparkSession.sparkContext.broadcast(dense_counts(rows, add, 1, BUCKETS)[0].astype(np.uint32))  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = often.value
        for b in batches:
            size, digest, prefix, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, n)
                k = len(s)
                p = k + (-percent * k) // 100 + 1 if k else 0
                f = counts[bucket(s)]
                if p and p < k:
                    near = np.flatnonzero(f <= np.partition(f, p - 1)[p - 1])
                    order = near[np.lexsort((s[near], f[near]))][:p]
                else:
                    order = np.lexsort((s, f))[:p]
                size.append(k)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefix.append(signed(s[order]))
                sig.append(parities(s))
            lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate(xs) if xs else [], pa.int64()))
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists(prefix), lists(sig)], names=["doc_id", "n_shingles", "digest", "prefix", "sig"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, prefix array<long>, sig array<long>")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The components (left, right) that a pair of linking sets (a, b) connects. Only sets of the pairs are shuffled."""
    sent = F.broadcast if pairs.count() <= MOST_IDS // 4 else lambda df: df
    a = full.join(sent(pairs), F.col("id") == F.col("a")).select(*PAIR, F.col("elements").alias("x"))
    b = full.join(sent(pairs.select("b").distinct()), F.col("id") == F.col("b")).select("b", F.col("elements").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            ok = []
            for x, y in zip(r.column(2), r.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            yield pa.record_batch([r.column(0), r.column(1)], names=["left", "right"]).filter(pa.array(ok, pa.bool_()))

    return a.join(b, "b").select("left", "right", "x", "y").mapInArrow(run, "left long, right long").distinct()


class _Sets:
    """Full sets of the documents that verification asked for so far."""

    def __init__(self, docs: DataFrame, n: int):
        self.text, self.n, self.tables = id_and_text(docs), n, []

    def of(self, pairs: DataFrame) -> DataFrame:
        """Sets of all documents of the pairs; those that aren't there yet are made from the texts."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        for t in self.tables:
            ids = ids.join(t.select("id"), "id", "left_anti")
        ids = stored(ids, "asked")
        asked = ids.count()
        if asked:
            n = self.n

            def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield pa.record_batch([b.column(0), pa.array([shingles(t, n).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "elements"])

            wanted = ids.withColumnRenamed("id", "doc_id")
            text = self.text.join(F.broadcast(wanted) if asked <= MOST_IDS else wanted, "doc_id", "left_semi")
            self.tables.append(stored(text.mapInArrow(elements, "id long, elements binary").where("length(elements) > 0"), "elements"))
        dropped(ids)
        return reduce(DataFrame.unionByName, self.tables)


class _Components:
    """Component of every document that is linked so far; of the others it is their own id."""

    def __init__(self):
        self.known: DataFrame | None = None
        self.few = False

    def add(self, links: DataFrame) -> bool:
        """Contract components that ``links`` (left, right) connects; whether there were any."""
        edges = stored(links.where("left <> right").distinct(), "links")
        some = not edges.isEmpty()
        if some:
            forest = star_forest(edges.select(F.col("left").alias("src"), F.col("right").alias("dst")))
            if self.known is not None:
                to = forest.select(F.col("id").alias("component"), F.col("component").alias("to"))
                moved = self.known.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
                forest = moved.unionByName(forest.join(self.known, "id", "left_anti"))
            before, self.known = self.known, stored(forest, "components")
            self.few = self.known.count() <= MOST_KNOWN
            if before is not None:
                dropped(before)
        dropped(edges)
        return some

    def label(self, rows: DataFrame, key: str = "id", name: str = "component") -> DataFrame:
        if self.known is None:
            return rows.withColumn(name, F.col(key))
        known = self.known.select(F.col("id").alias(key), F.col("component").alias(name))
        return rows.join(F.broadcast(known) if self.few else known, key, "left").withColumn(name, F.coalesce(name, key))


def components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, and class_id: the smallest doc_id with the same set."""
    with small_batches(docs.sparkSession):
        return _components(docs, n, percent)


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    wide = stored(sets(docs, n, percent), "shingles")
    every = stored(wide.select("doc_id", "n_shingles", "digest"), "digests")
    classes = stored(every.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    first = stored(_first_rows(wide, classes), "firsts")
    dropped(wide)
    met = stored(_places(first, percent), "met")
    marks = stored(first.drop("prefix"), "parities")
    dropped(first)

    found, full, tried = _Components(), _Sets(docs, n), []
    many = every.groupBy("doc_id").agg(F.countDistinct("digest").alias("c")).where("c > 1 AND doc_id IS NOT NULL").select("doc_id")
    found.add(every.join(many, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("left"), F.col("id").alias("right")))

    def link(pairs: DataFrame) -> None:
        tried.append(stored(pairs.select(*PAIR), "pairs"))
        if not tried[-1].isEmpty():
            found.add(verified(tried[-1], full.of(tried[-1]), percent))

    def nearest(pairs: DataFrame, *ends: str) -> DataFrame:
        """For each document (``a``, ``b``) or component (``left``, ``right``) its nearest pair."""
        best = F.min_by(F.struct(*PAIR), F.struct("apart", "a", "b")).alias("p")
        return pairs.withColumn("of", F.explode(F.array(*ends))).groupBy("of").agg(best).select("p.*").distinct()

    def untried(pairs: DataFrame, since: int = 0) -> DataFrame:
        return pairs.join(reduce(DataFrame.unionByName, tried[since:]).select("a", "b"), ["a", "b"], "left_anti")

    def apart(pairs: DataFrame) -> DataFrame:
        return found.label(found.label(pairs.drop("left", "right"), "a", "left"), "b", "right").where("left <> right")

    small = stored(_marked(_small(met, percent), marks, percent), "small-places")
    link(nearest(apart(small), "a", "b"))
    placed = stored(_larger(met, marks), "placed")
    dropped(met, marks)
    rows, left = placed.count(), None
    for turn in count():  # each but the first takes away a tenth of the pairs that are left
        here = stored(found.label(placed), "labelled")
        was, left = left, _left(here)
        if left <= rows or (was is not None and 10 * left > 9 * was):
            break
        link(nearest(untried(_stars(here, percent, turn)), "a", "b"))
        dropped(here)
    rest = stored(apart(untried(_rest(here, percent).unionByName(small).groupBy("a", "b").agg(F.min("apart").alias("apart")))), "rest")
    dropped(here, placed, small)
    for turn in range(NEAREST + 1):
        if rest.isEmpty():
            break
        link(nearest(rest, "left", "right") if turn < NEAREST else rest)
        now = stored(apart(untried(rest, -1)), "rest")
        dropped(rest)
        rest = now
    dropped(rest, *tried, *full.tables)

    named = found.label(classes.withColumnRenamed("id", "class_id"), "class_id", "component_id")
    out = every.join(named, "digest", "left")
    return found.label(out, "doc_id", "own").select("doc_id", "n_shingles", F.coalesce("component_id", "own").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def _first_rows(every: DataFrame, classes: DataFrame) -> DataFrame:
    """The row of each class that stands for it; a row that occurs twice may stand twice."""
    same = (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("i"))
    first = every.join(classes.select(F.col("digest").alias("d"), F.col("id").alias("i")), same, "left_semi")
    return first.select(F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("n"), "prefix", *[F.col("sig")[i].alias(c) for i, c in enumerate(SIG)])


def _places(first: DataFrame, percent: int) -> DataFrame:
    """gram, c, id, n, pos: the prefix n-grams at which a pair can meet, and how many sets hold them."""
    places = first.select("id", "n", F.posexplode("prefix").alias("pos", "gram"))
    smaller = F.col("pos") <= F.col("n") - needed("n", "n", percent)  # the smaller set of a pair has the place here
    met = places.groupBy("gram").agg(F.count("*").alias("c"), F.max(smaller).alias("met")).where("c > 1 AND met").select("gram", "c")
    return places.join(met, "gram")


def _bounds(percent: int) -> tuple[Column, Column]:
    """Of rows x and y of a place: whether lengths and positions allow a link, and the largest difference that links."""
    need = needed("x.n", "y.n", percent)
    reach = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return reach >= need, F.col("x.n") + F.col("y.n") - 2 * need


def _differ() -> Column:
    """The least difference of x and y by their parities."""
    return sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SIG), F.lit(0))


def _small(met: DataFrame, percent: int) -> DataFrame:
    """a < b, and their sizes, of all pairs at places of up to ``SMALL`` that lengths and positions don't rule out."""
    rows = met.where(F.col("c") <= SMALL)
    pairs = rows.alias("x").join(rows.alias("y"), "gram").where((F.col("x.id") < F.col("y.id")) & _bounds(percent)[0])
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _marked(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs that the parities don't rule out, with their least relative difference."""
    allowed = F.col("x.n") + F.col("y.n") - 2 * needed("x.n", "y.n", percent)
    both = pairs.join(marks.alias("x"), F.col("a") == F.col("x.id")).join(marks.alias("y"), F.col("b") == F.col("y.id"))
    return both.where(_differ() <= allowed).groupBy("a", "b").agg(F.min(_differ() / F.greatest(allowed, F.lit(1))).alias("apart"))


def _larger(met: DataFrame, marks: DataFrame) -> DataFrame:
    """The larger places, with the parities and the larger place before."""
    more = met.where(F.col("c") > SMALL).drop("c").join(marks, ["id", "n"])
    return more.withColumn("before", F.lag("gram").over(Window.partitionBy("id", "n", SIG[0]).orderBy("pos")))


def _pairs(left: DataFrame, right: DataFrame, percent: int, more: Column) -> DataFrame:
    """Pairs of one place that no bound rules out, smaller id first, each once with its least relative difference."""
    reach, allowed = _bounds(percent)
    fits = (F.col("x.component") != F.col("y.component")) & reach & (_differ() <= allowed)
    ends = [F.struct(F.col(f"{t}.id"), F.col(f"{t}.component")) for t in "xy"]
    met = left.alias("x").join(right.alias("y"), "gram").where(more & fits)
    met = met.select(F.least(*ends).alias("s"), F.greatest(*ends).alias("t"), (_differ() / F.greatest(allowed, F.lit(1))).alias("apart"))
    return met.select(F.col("s.id").alias("a"), F.col("t.id").alias("b"), F.col("s.component").alias("left"), F.col("t.component").alias("right"), "apart").groupBy(*PAIR).agg(F.min("apart").alias("apart"))


def _left(here: DataFrame) -> int:
    """At most how many pairs ``_rest`` would look at."""
    sizes = here.groupBy("gram", "component").agg(F.count("*").alias("c")).groupBy("gram").agg(F.sum("c").alias("n"), F.max("c").alias("most"))
    return sizes.agg(F.sum((F.col("n") - F.col("most")) * F.col("n"))).first()[0] or 0


def _stars(here: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each member of a place with one of them, another one each turn."""
    centre = here.groupBy("gram").agg(F.min_by(F.struct("id", "n", "pos", "component", *SIG), F.struct(F.xxhash64("id", "gram", F.lit(turn)), "id", "pos")).alias("c")).select("gram", "c.*")
    return _pairs(here, centre, percent, F.lit(True))


def _rest(here: DataFrame, percent: int) -> DataFrame:
    """All pairs at a place that are not connected yet, from the side of its smaller components.

    Two documents with the same place before this one meet there already, with no tighter bounds, and are left to it.
    """
    sizes = here.groupBy("gram", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("gram").agg(F.count("*").alias("k"), F.max_by("component", F.struct("c", "component")).alias("main")).where("k > 1").select("gram", "main")
    both = here.join(main, "gram")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    return _pairs(both.where("component <> main"), both, percent, once & F.coalesce(F.col("x.before") != F.col("y.before"), F.lit(True))).drop("left", "right")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Of rows with one doc_id one stays. A row without a doc_id takes part under a negative number from its text's hash,
    as the last of its component; of such rows with equal texts one stays.
    """
    key = fresh(docs, "key")
    number = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), "text").bitwiseAND(F.lit(~LAST)).bitwiseOR(F.lit(2 * LAST)))
    rows = docs.withColumn(key, number)
    # Numbers from hashes come last, behind every doc_id.
    found = stored(components(docs.select(number.alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("id"), "component_id"), "near-copies")
    first = F.min(F.struct((F.col("id") < LAST).alias("late"), "id"))["id"]
    stays = found.groupBy(F.coalesce("component_id", "id")).agg(first.alias("id")).select("id")
    gone_key = fresh(rows, "gone_key")
    gone = found.join(stays, "id", "left_anti").select(F.col("id").alias(gone_key)).distinct()
    left = rows.join(gone, F.col(key) == F.col(gone_key), "left_anti")
    # Rows that share a number are few or equal; only they are put together.
    again_key = fresh(rows, "again_key")
    again = found.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias(again_key))
    once, more = (left.join(again, F.col(key) == F.col(again_key), how) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.dropDuplicates([key])).select(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
