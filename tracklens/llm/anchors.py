"""Content-selected places (minimisers) of texts, and which of them hold words that occur again anywhere.

Of each window of ``width`` words the place with the smallest hash of ``k`` words is its anchor, so equal windows have
their anchors at equal places. A window can only occur again if the words at its anchor do. The hashes of all anchors
are dealt by hash and sorted; an equal neighbour makes an anchor repeated. A task first drops what it knows itself: of
the anchors that occur again in one batch only one is dealt, so a passage in a third of all rows costs one row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import mixed, signed, stored, window_hashes

LEAST_LONG = -(1 << 63)
#: Repeated doc_ids that may be broadcast: at most this many longs, 8 MB; more are joined by shuffling.
MOST_IDS = 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc, ord, text (bytes): the pair (doc, ord) names a document and orders all of them.

    ``doc`` is the doc_id and ``ord`` 0. Where a doc_id is on several rows, ``ord`` is a hash of the text, so that
    different texts are documents of their own and equal ones are one. A null doc_id has the least ``doc`` and an ``ord``
    below 0, from its text too: it stands before all others, and no key gathers the rows without an id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    again = stored(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")), "repeated-ids")
    n = again.count()
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)
    if n:
        rows = rows.join(F.broadcast(again) if n <= MOST_IDS else again, "doc_id", "left")
    own = F.when(F.col("again"), h).otherwise(0) if n else F.lit(0)
    order = F.when(F.col("doc_id").isNull(), h + F.lit(LEAST_LONG)).otherwise(own).cast("long")
    return rows.select(F.coalesce("doc_id", F.lit(LEAST_LONG)).alias("doc"), order.alias("ord"), "text")


def doc_id(doc: str = "doc", ord_: str = "ord"):
    return F.when(F.col(ord_) >= 0, F.col(doc))


def in_order(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """doc and ord of a batch in their order, and which row stands at each place of it."""
    doc, order = b.column(0).to_numpy(), b.column(1).to_numpy()
    by = np.lexsort((order, doc))
    return doc[by], order[by], by.tolist()


def anchors_of(h: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word runs, and for each window of ``width`` words the place of its anchor."""
    runs = window_hashes(h, k, seed=3)
    if len(h) < width:
        return runs, np.zeros(0, np.int64)
    return runs, sliding_window_view(runs, width - k + 1).argmin(axis=1) + np.arange(len(h) - width + 1)


def firsts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted order by value, then place: places of the first of each value, and for every place its first."""
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return first, first[back]


def repeated_anchors(rows: DataFrame, hashed, k: int, width: int, parts: int) -> DataFrame:
    """doc, ord and the places of the anchors whose words occur at another place too. ``rows``: doc, ord, text."""
    dealt_names, names = ["h", "doc", "ord", "at", "known"], ["doc", "ord", "at"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, which, at = [], [], []
            docs, ords, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for i, t in enumerate(texts):
                runs, anchor = anchors_of(hashed(t), k, width)
                if len(anchor):
                    p = np.unique(anchor)
                    h.append(runs[p])
                    at.append(p)
                    which.append(np.full(len(p), i))
            if not h:
                continue
            h, which, at = map(np.concatenate, (h, which, at))
            doc, order = docs[which], ords[which]
            first, own = firsts(h)
            again = np.bincount(own, minlength=len(h))[own] > 1
            later = again & (own != np.arange(len(h)))
            deal = np.where(later, spread(doc, order, at), h)
            yield pa.record_batch([pa.array(signed(deal)), pa.array(doc), pa.array(order), pa.array(at.astype(np.int32)), pa.array(again)], names=dealt_names)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row waits for its successor

        def out(h, doc, order, at, known, before, after):
            same = known.copy()
            same[1:] |= h[1:] == h[:-1]
            same[:-1] |= h[1:] == h[:-1]
            if before is not None and len(h):
                same[0] |= h[0] == before
            if after is not None and len(h):
                same[-1] |= h[-1] == after
            return pa.record_batch([pa.array(doc[same]), pa.array(order[same]), pa.array(at[same])], names=names)

        before = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            held = [c[-1:] for c in now]
            if len(now[0]) > 1:
                yield out(*[c[:-1] for c in now], before, held[0][0])
                before = now[0][-2]
        if held is not None:
            yield out(*held, before, None)

    dealt = rows.mapInArrow(emit, "h long, doc long, ord long, at int, known boolean").repartition(parts, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(flag, "doc long, ord long, at int").groupBy("doc", "ord").agg(F.collect_set("at").alias("places"))


def spread(doc: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each coordinate, to deal rows that are settled already."""
    return mixed((doc ^ order).view(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
