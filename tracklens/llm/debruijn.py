"""Substring dedup by De Bruijn compaction (op10).

The edges of the graph are the token k-mers (``WINDOW`` words) of all documents. Only edges that can repeat are dealt:
those whose anchor (see ``anchors``) repeats. Equal edges meet in one task, sorted by their source coordinates; every
occurrence but the first is a repeated edge and carries the coordinates of an earlier one, which name it. Edges with one
anchor that follow each other, here and at the source, leave that task as one piece.

Compaction: a node is the place between two edges of a path from one source. Where a piece ends at a node and another
begins there, the node has one way in and one way out and the pieces join (``compacted``: begins and ends meet in one
full outer join); a node with only a begin or only an end is where a document enters or leaves the source's path: a branching node. The
paths between branching nodes are the repeated spans, in source coordinates: so many words of this document from here on
equal those of that document from there on. ``branching`` has all these nodes and ``unitigs`` cuts the sources at them.

Verification (``unequal``): edges are compared by 96 bits, of which 20 come from their anchor, so that edges with
one anchor stay together. Every document with paths or branching nodes is read again and gives sums of other word hashes,
over its own paths and up to its nodes; by them the words of each whole span are compared at source and copy. If any
span differs, edges that aren't equal had equal hashes, and all is done again with the next seed.

Defined cases: null and empty texts have no words, no spans, and the SHA-256 of the empty string; texts of fewer than
``WINDOW`` words are left whole; rows with one doc_id and equal texts are one document and get equal results, its
different texts are separate documents in the order of their hashes; a null doc_id stands before all others; an empty
table gives an empty result; clashing extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .anchors import MOST_IDS, anchors_of, doc_id, firsts, in_order, keyed, repeated_anchors, spread
from .base import dropped, mixed, signed, stored, table, window_hashes, word_hashes, words_of

WINDOW, K = 20, 8
#: Bits of an edge's first hash that come from its anchor.
ANCHOR_BITS = 20
#: Seeds of the edges' hashes, tried in turn.
SEEDS = (1, 11, 21, 31)

#: h, then the second hash with an earlier place below it, the coordinates, place with length (0 for an edge), source.
EDGE = "h long, h2 long, doc long, ord long, at_len long, from_doc long, from_ord long"
PIECE = "doc long, ord long, at int, len int, from_doc long, from_ord long, from_at int"
HERE, THERE = ["doc", "ord"], ["from_doc", "from_ord"]


def hashed(text: bytes | None) -> np.ndarray:
    return word_hashes(words_of(text))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _two(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers of 32 bits in one long."""
    return (high.astype(np.int64) << 32) | low.astype(np.int64)


def pieces(doc, order, at, from_doc, from_ord, from_at) -> tuple[np.ndarray, ...]:
    """Edges (sorted or not) as pieces of edges that follow each other here and at the source; the columns of ``PIECE``."""
    by = np.lexsort((at, order, doc))
    doc, order, at, from_doc, from_ord, from_at = (x[by] for x in (doc, order, at, from_doc, from_ord, from_at))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (order[1:] != order[:-1]) | (at[1:] != at[:-1] + 1)
    new[1:] |= (from_doc[1:] != from_doc[:-1]) | (from_ord[1:] != from_ord[:-1]) | (from_at[1:] != from_at[:-1] + 1)
    i = np.flatnonzero(new)
    n = np.diff(np.append(i, len(doc)))
    return doc[i], order[i], at[i].astype(np.int32), n.astype(np.int32), from_doc[i], from_ord[i], from_at[i].astype(np.int32)


def edges(rows: DataFrame, places: DataFrame, window: int, k: int, seed: int) -> DataFrame:
    """Edges that can repeat, and pieces that a batch already knows to be repeated."""
    names = _names(EDGE)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, h2, which, at = [], [], [], []
            texts, marks = b.column(2).to_pylist(), b.column(3)
            docs, ords, by = in_order(b)
            for i, row in enumerate(by):
                w = hashed(texts[row])
                places_, anchor = anchors_of(w, k, window)
                live = np.flatnonzero(np.isin(anchor, np.asarray(marks[row].values.to_numpy())))
                if len(live):
                    top = places_[anchor[live]] >> np.uint64(64 - ANCHOR_BITS) << np.uint64(64 - ANCHOR_BITS)
                    h.append(top | window_hashes(w, window, seed)[live] >> np.uint64(ANCHOR_BITS))
                    h2.append(window_hashes(w, window, seed + 1)[live].astype(np.uint32).view(np.int32))
                    at.append(live)
                    which.append(np.full(len(live), i))
            if not h:
                continue
            h, h2, which, at = map(np.concatenate, (h, h2, which, at))
            doc, order = docs[which], ords[which]
            first, own = firsts(mixed(h) ^ h2.view(np.uint32).astype(np.uint64))
            none = np.zeros(len(first), np.int64)
            yield pa.record_batch([pa.array(x) for x in (signed(h[first]), _two(h2[first], none), doc[first], order[first], _two(at[first], none), none, none)], names=names)
            later = np.flatnonzero((doc != doc[own]) | (order != order[own]) | (at != at[own]))  # not the same place of a row that is there twice
            if len(later):
                f = own[later]
                d, o, a, n, fd, fo, fa = pieces(doc[later], order[later], at[later], doc[f], order[f], at[f])
                yield pa.record_batch([pa.array(x) for x in (signed(spread(d, o, a)), _two(np.zeros(len(d)), fa), d, o, _two(a, n), fd, fo)], names=names)

    return rows.join(places, HERE).select(*HERE, "text", "places").mapInArrow(emit, EDGE)


def later_pieces(dealt: DataFrame) -> DataFrame:
    """Pieces of edges that also occur at an earlier place. ``dealt``: edges, sorted by hashes and coordinates."""
    names = _names(PIECE)
    low = np.int64(0xFFFFFFFF)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # hashes and coordinates of the first occurrence of the newest edge
        for b in batches:
            if not b.num_rows:
                continue
            h, h2, doc, order, at_len, from_doc, from_ord = (c.to_numpy() for c in b.columns)
            known = (at_len & low) > 0
            if known.any():
                cols = doc, order, (at_len >> 32).astype(np.int32), (at_len & low).astype(np.int32), from_doc, from_ord, (h2 & low).astype(np.int32)
                yield pa.record_batch([pa.array(c[known]) for c in cols], names=names)
                h, h2, doc, order, at_len = (x[~known] for x in (h, h2, doc, order, at_len))
                if not len(h):
                    continue
            if last is not None:
                h, h2, doc, order, at_len = (np.concatenate([[x], y]) for x, y in zip(last, (h, h2, doc, order, at_len), strict=True))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = np.flatnonzero((doc != doc[first]) | (order != order[first]) | (at_len != at_len[first]))
            if len(later):
                f, at = first[later], at_len >> 32
                yield pa.record_batch([pa.array(c) for c in pieces(doc[later], order[later], at[later], doc[f], order[f], at[f])], names=names)
            last = tuple(x[first[-1]] for x in (h, h2, doc, order, at_len))

    return dealt.mapInArrow(flag, PIECE)


def compacted(found: DataFrame) -> DataFrame:
    """``PIECE`` rows of whole paths, numbered: pieces of one source joined at every node that has one way in and one way out."""
    line = [*HERE, *THERE, "shift"]
    found = found.withColumn("shift", F.col("from_at") - F.col("at"))
    begins = found.select(*line, F.col("at").alias("node")).distinct().withColumn("b", F.lit(True))
    ends = found.select(*line, (F.col("at") + F.col("len")).alias("node")).distinct().withColumn("e", F.lit(True))
    open_ = begins.join(ends, [*line, "node"], "full_outer").where("b IS NULL OR e IS NULL")
    # Along one source begins and ends alternate; a document has at most as many as words.
    paths = open_.withColumn("to", F.lead("node").over(Window.partitionBy(*line).orderBy("node"))).where("b")
    return paths.select(*HERE, F.col("node").alias("at"), (F.col("to") - F.col("node")).alias("len"), *THERE, (F.col("node") + F.col("shift")).alias("from_at"), F.monotonically_increasing_id().alias("path"))


def branching(paths: DataFrame, window: int) -> DataFrame:
    """doc, ord, at: where in a source paths begin or end (after their last word)."""
    ends = [F.struct(F.col("from_doc").alias("doc"), F.col("from_ord").alias("ord"), (F.col("from_at") + more).alias("at")) for more in (F.lit(0), F.col("len") + (window - 1))]
    return paths.select(F.explode(F.array(*ends)).alias("n")).select("n.*").distinct()


def unitigs(paths: DataFrame, window: int = WINDOW) -> DataFrame:
    """The nonbranching paths of each source: doc_id, start, n_words, and how many copies pass through all of it."""
    steps = paths.select(*THERE, F.explode(F.array(F.struct(F.col("from_at").alias("start"), F.lit(1).alias("s")), F.struct((F.col("from_at") + F.col("len")).alias("start"), F.lit(-1).alias("s")))).alias("x"))
    cuts = steps.groupBy(*THERE, "x.start").agg(F.sum("x.s").alias("s"))
    along = Window.partitionBy(*THERE).orderBy("start")
    cut = cuts.select("*", F.sum("s").over(along).alias("copies"), F.lead("start").over(along).alias("to")).where("copies > 0")
    return cut.select(doc_id(*THERE).alias("doc_id"), "start", (F.col("to") - F.col("start") + window - 1).alias("n_words"), "copies")


def unequal(rows: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """The numbers of the paths whose words differ between document and source.

    With word hashes h and an odd b, a text's sums are s(x) = sum of h(i) b^i for i < x. Of its own paths a document gives
    (s(end) - s(begin)) / b^begin, which doesn't depend on the place; as a source it gives s and b^x at its nodes.
    """
    value, odd = "path long, doc long, ord long, at int, upto long, power long", 0x9E3779B97F4A7C15
    inverse = pow(odd, -1, 1 << 64)

    def powers(base: int, n: int) -> np.ndarray:
        return np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, given = [], []
            for row, (text, mine, places) in enumerate(zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True)):
                words = words_of(text)
                at = places.values.to_numpy() if places.is_valid else np.zeros(0, np.int32)
                path, begin, n = (mine.values.field(c).to_numpy() for c in range(3)) if mine.is_valid else [np.zeros(0, np.int64)] * 3
                end = begin + n + (window - 1)
                ends = np.concatenate([at, begin, end])
                low, high = int(ends.min()), int(ends.max())  # words outside play no part
                power = powers(odd, high)
                h = np.fromiter(map(xxhash.xxh64_intdigest, words[low:high], repeat(77)), np.uint64, high - low)
                upto = np.append(np.uint64(0), np.cumsum(h * power[low:high]))
                own.append((path, signed((upto[end - low] - upto[begin - low]) * powers(inverse, high)[begin])))
                given.append((np.full(len(at), row), at, signed(upto[at - low]), signed(power[at])))
            if own:
                path, same = map(np.concatenate, zip(*own, strict=True))
                row, at, upto, power = map(np.concatenate, zip(*given, strict=True))
                none = pa.nulls(len(path), pa.int64())
                yield pa.record_batch([pa.array(path), none, none, none.cast(pa.int32()), pa.array(same), none], names=_names(value))
                yield pa.record_batch([pa.nulls(len(row), pa.int64()), pa.array(b.column(0).to_numpy()[row]), pa.array(b.column(1).to_numpy()[row]), pa.array(at), pa.array(upto), pa.array(power)], names=_names(value))

    # Of a document at most as many paths and nodes as words.
    mine = paths.groupBy(*HERE).agg(F.collect_list(F.struct("path", "at", "len")).alias("own"))
    nodes = branching(paths, window).groupBy(*HERE).agg(F.collect_set("at").alias("places"))
    wanted = stored(mine.join(nodes, HERE, "full_outer"), "nodes")
    if wanted.count() <= MOST_IDS // 2:  # other texts needn't be shuffled
        rows = rows.join(F.broadcast(wanted.select(*HERE)), HERE, "left_semi")
    told = stored(rows.join(wanted, HERE).select(*HERE, "text", "own", "places").mapInArrow(sums, value), "sums")
    dropped(wanted)
    ends = [F.struct(F.lit(i).alias("i"), (F.col("from_at") + more).alias("x")) for i, more in enumerate((F.lit(0), F.col("len") + (window - 1)))]
    asked = paths.select("path", F.col("from_doc").alias("d"), F.col("from_ord").alias("o"), F.explode(F.array(*ends)).alias("e")).select("path", "d", "o", "e.*")
    source = told.where("path IS NULL").drop("path")
    sides = asked.join(source, (F.col("d") == F.col("doc")) & (F.col("o") == F.col("ord")) & (F.col("x") == F.col("at"))).select("path", "i", "upto", "power")
    sides = sides.unionByName(told.where("path IS NOT NULL").select("path", F.lit(2).alias("i"), "upto", "power"))
    both = sides.groupBy("path").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i, c in ((0, "upto"), (0, "power"), (1, "upto"), (2, "upto"))])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, power, end, own = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns[1:])
            yield b.select(["path"]).filter(pa.array(end - begin != own * power))

    return both.mapInArrow(differ, "path long")


def repeated_paths(rows: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """All words that occur earlier, as verified paths (``PIECE``; len counts edges). ``rows``: as ``keyed`` has them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = stored(repeated_anchors(rows, hashed, k, window, parts), "anchors")
    for seed in SEEDS:
        dealt = edges(rows, places, window, k, seed).repartition(parts, F.shiftrightunsigned("h", 64 - ANCHOR_BITS)).sortWithinPartitions("h", "h2", *HERE, "at_len")
        found = stored(later_pieces(dealt), "pieces")
        paths = stored(compacted(found), "paths")
        dropped(found)
        wrong = stored(unequal(rows, paths, window), "unequal")
        if wrong.isEmpty():
            dropped(places, wrong)
            return paths
        dropped(paths, wrong)
    raise RuntimeError("unequal words had equal hashes under every seed")


def cleaned(text: bytes | None, found: list[dict], window: int) -> tuple[list[bytes], int]:
    """The words that no repeated span covers, and the number of words."""
    words = words_of(text)
    if not found:
        return words, len(words)
    keep = np.ones(len(words), bool)
    for r in found:
        keep[r["at"] : r["at"] + r["len"] + window - 1] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()], len(words)


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text that stays) and its SHA-256, spans with source coordinates."""
    rows = keyed(docs)
    # The paths of one document: as many as its words at most.
    paths = repeated_paths(rows, window, k).groupBy(*HERE).agg(F.array_sort(F.collect_list(F.struct(*_names(PIECE)[2:]))).alias("paths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept, sha, out = [], [], [], [], []
            for text, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                stay, total = cleaned(text, found or [], window)
                joined = b" ".join(stay)
                n.append(total)
                gone.append(total - len(stay))
                kept.append(joined)
                sha.append(hashlib.sha256(joined).hexdigest())
                out.append([{"start": r["at"], "n_words": r["len"] + window - 1, "from_doc_id": r["from_doc"] if r["from_ord"] >= 0 else None, "from_start": r["from_at"]} for r in found or []])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("from_doc_id", pa.int64()), ("from_start", pa.int32())]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string()), pa.array(out, kind)], names=names)

    schema = "doc long, ord long, n_words long, n_removed long, kept binary, kept_sha256 string, spans array<struct<start: int, n_words: int, from_doc_id: long, from_start: int>>"
    names = [*HERE, "n_words", "n_removed", "kept", "kept_sha256", "spans"]
    out = rows.join(paths, HERE, "left").select(*HERE, "text", "paths").mapInArrow(run, schema)
    return out.select(doc_id().alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "kept_sha256", "spans")


def op10_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
