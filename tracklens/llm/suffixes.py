"""Substring dedup by sparse suffix arrays (op2).

A suffix is kept only at a content-selected place: of each window of ``LEAST`` words the anchor (see ``anchors``), so
every passage of ``LEAST`` words keeps one at the same place wherever it stands. Suffixes whose first ``K`` words occur
nowhere else are dropped first. The others carry the hashes of ``LEAST`` words to the right and of the words to the left
that a passage around the place can reach, are dealt by their first words and sorted as a suffix array is. A run of
neighbours has the same first words. From there each match is extended: with 0, 1, 2 ... words to the left, and as many
to the right as make ``LEAST``, it is compared with the whole run by the hash of these words; texts may branch on both
sides, so the next neighbour in one order wouldn't do. What is shared is reported for all documents that have it, from
the leftmost to the rightmost word that any extension reached; longer passages are the union of the matches at their
successive places.

A batch deals equal suffixes with equal left sides once and reports the others itself, so a passage in a third of all
rows costs one row a batch and place. Suffixes with the same first words are handled in pieces of ``CHUNK`` rows; the hashes of
all windows that later rows can share are carried from piece to piece, so a task holds about 1 KB for each different
suffix of the most common first words.

Words are compared by 32 bits each, a window by 64 bits of them.

Defined cases: null, empty and short texts have no suffixes; only documents with a match are returned; rows with one
doc_id and equal texts are one document; a null doc_id stands before all others; an empty table gives an empty result;
clashing extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import anchors_of, doc_id, firsts, in_order, keyed, repeated_anchors, spread
from .base import dropped, mixed, signed, stored, table, word_hashes, words_of

LEAST, K = 50, 16
CHUNK = 100_000

SUFFIX = "g long, right binary, left binary, doc long, ord long, at int, n_words int, start int, end int, from_doc long, from_ord long"
MATCH = "doc long, ord long, n_words int, start int, end int, from_doc long, from_ord long"
_NAMES = [c.split()[0] for c in MATCH.split(", ")]


def hashed(text: bytes | None) -> np.ndarray:
    return word_hashes(words_of(text))


def sides(w: np.ndarray, places: np.ndarray, right: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes after each place, and before it in reverse; 0 beyond the text."""
    v = w.astype(np.uint32)
    v[v == 0] = 1
    v = np.concatenate([np.zeros(left, np.uint32), v, np.zeros(right, np.uint32)])
    r = v[places[:, None] + left + np.arange(right)]
    return r.byteswap(), v[places[:, None] + left - 1 - np.arange(left)].byteswap()  # big-endian bytes sort as numbers


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words of each pair of rows agree, not counting words beyond the text."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def suffixes(rows: DataFrame, places: DataFrame, least: int, k: int) -> DataFrame:
    left = least - k

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, r, l_, which, at, total = [], [], [], [], [], []
            texts, marks = b.column(2).to_pylist(), b.column(3)
            docs, ords, by = in_order(b)
            for i, row in enumerate(by):
                w = hashed(texts[row])
                runs, anchor = anchors_of(w, k, least)
                p = np.intersect1d(anchor, np.asarray(marks[row].values.to_numpy()))
                if len(p):
                    a, z = sides(w, p, least, left)
                    g.append(runs[p])
                    r.append(a)
                    l_.append(z)
                    which.append(np.full(len(p), i))
                    at.append(p)
                    total.append(np.full(len(p), len(w), np.int64))
            if not g:
                continue
            g, r, l_, which, at, total = map(np.concatenate, (g, r, l_, which, at, total))
            doc, order = docs[which], ords[which]
            odd = np.random.default_rng(5).integers(1, 1 << 62, least + left, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            both = mixed((r.astype(np.uint64) * odd[:least]).sum(axis=1, dtype=np.uint64) + (l_.astype(np.uint64) * odd[least:]).sum(axis=1, dtype=np.uint64)) ^ g
            first, own = firsts(both)
            none = np.zeros(len(first), np.int32)
            yield pa.record_batch([pa.array(signed(g[first])), _bytes(r[first]), _bytes(l_[first]), pa.array(doc[first]), pa.array(order[first]), pa.array(at[first].astype(np.int32)), pa.array(total[first].astype(np.int32)), pa.array(none), pa.array(none), *[pa.array(none.astype(np.int64))] * 2], names=names)
            later = np.flatnonzero(own != np.arange(len(g)))
            if len(later):
                f = own[later]
                i, j = np.concatenate([later, f]), np.concatenate([f, later])
                m = matches(doc, order, at, total, i, j, common(r[i], r[j]), common(l_[i], l_[j]), least)
                if m.num_rows:
                    deal = signed(spread(*(m.column(c).to_numpy() for c in (0, 1, 3))))
                    blank = pa.array([b""] * len(deal), pa.binary())
                    yield pa.record_batch([pa.array(deal), blank, blank, *m.columns[:2], pa.array(np.full(len(deal), -1, np.int32)), *m.columns[2:]], names=names)

    names = [c.split()[0] for c in SUFFIX.split(", ")]
    return rows.join(places, ["doc", "ord"]).select("doc", "ord", "text", "places").mapInArrow(emit, SUFFIX)


def _bytes(m: np.ndarray) -> pa.Array:
    n, width = m.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * 4 * width), pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def matches(doc, order, at, total, i, j, right, left, least: int) -> pa.RecordBatch:
    """What rows i share with rows j, where it is long enough; a place never matches itself."""
    ok = np.flatnonzero((right + left >= least) & ((doc[i] != doc[j]) | (order[i] != order[j]) | (at[i] != at[j])))
    i, j, right, left = i[ok], j[ok], right[ok], left[ok]
    return _matches(doc[i], order[i], total[i], at[i] - left, at[i] + right, doc[j], order[j])


def _matches(doc, order, total, start, end, from_doc, from_ord) -> pa.RecordBatch:
    cols = doc, order, total.astype(np.int32), start.astype(np.int32), end.astype(np.int32), from_doc, from_ord
    return pa.record_batch([pa.array(c) for c in cols], names=_NAMES)


class Seen(NamedTuple):
    """Windows of a run with ``left`` words before the place, sorted by hash: one place of each, and whether it was told."""

    h: np.ndarray
    doc: np.ndarray
    ord: np.ndarray
    at: np.ndarray
    total: np.ndarray
    told: np.ndarray


def shared_windows(rows: list[np.ndarray], least: int, seen: list[Seen] | None, last: np.ndarray | None, go_on: bool) -> tuple[list[pa.RecordBatch], list[Seen] | None]:
    """Matches of all rows that share a window of ``least`` words around their places with another row or ``seen``.

    ``rows`` holds whole runs, save that the first may continue ``seen``, whose newest suffix is ``last``. With
    ``go_on`` it is part of one run, and the windows that rows after it can still have are returned.
    """
    g, r, l_, doc, order_, at, total = rows
    n, width = len(g), l_.shape[1]
    odd = np.random.default_rng(7).integers(1, 1 << 62, least + width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a = g.view(np.uint64) + (r.astype(np.uint64) * odd[:least]).sum(axis=1, dtype=np.uint64)
    most, fewest = np.full(n, -1), np.full(n, -1)
    from_doc, from_ord = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    agree = common(r, np.broadcast_to(r[-1], r.shape)) if go_on else None
    out, after = [], []
    for left in range(width + 1):
        if left:
            a = a - r[:, least - left].astype(np.uint64) * odd[least - left] + l_[:, left - 1].astype(np.uint64) * odd[least + left - 1]
        whole = np.flatnonzero((r[:, least - left - 1] != 0) & ((l_[:, left - 1] != 0) if left else True))
        old = seen[left] if seen else Seen(*[np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int32, np.int32, bool)])
        k = len(old.h)
        h = np.concatenate([old.h, mixed(a[whole])])
        order = np.argsort(h, kind="stable")  # what was seen stands first among equals
        same = h[order[1:]] == h[order[:-1]]
        before, then = np.append(False, same), np.append(same, False)
        shared = np.flatnonzero(before | then)
        docs, ords = np.concatenate([old.doc, doc[whole]]), np.concatenate([old.ord, order_[whole]])
        of = order[shared]
        other = order[np.where(before[shared], shared - 1, shared + 1)]
        new = of >= k
        i = whole[of[new] - k]
        most[i] = left
        fewest[i] = np.where(fewest[i] < 0, left, fewest[i])
        d, o = docs[other[new]], ords[other[new]]
        less = (d < from_doc[i]) | ((d == from_doc[i]) & (o < from_ord[i]))
        from_doc[i], from_ord[i] = np.where(less, d, from_doc[i]), np.where(less, o, from_ord[i])
        late = ~new
        late[late] = ~old.told[of[late]]
        if late.any():
            o = of[late]
            out.append(_matches(old.doc[o], old.ord[o], old.total[o], old.at[o] - left, old.at[o] + least - left, docs[other[late]], ords[other[late]]))
        if go_on:  # rows to come agree with the last one on every word that they share with rows before it
            live = np.concatenate([np.full(k, k > 0 and bool((last[: least - left] == r[-1, : least - left]).all())), agree[whole] >= least - left])
            kept = np.flatnonzero(~before & live[order])
            of = order[kept]
            ats, totals = np.concatenate([old.at, at[whole]]), np.concatenate([old.total, total[whole]])
            after.append(Seen(h[of], docs[of], ords[of], ats[of], totals[of], then[kept] | np.append(old.told, np.zeros(len(whole), bool))[of]))
    i = np.flatnonzero(most >= 0)
    if len(i):
        # All windows of a place hold it, so they are one passage.
        out.append(_matches(doc[i], order_[i], total[i], at[i] - most[i], at[i] + least - fewest[i], from_doc[i], from_ord[i]))
    return out, after if go_on else None


def over_runs(pieces: Iterator[list[np.ndarray]], least: int, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """``shared_windows`` of rows in order; of a run beyond ``most`` rows the windows are carried on, not the rows."""
    held, seen, last, before = None, None, None, None  # rows of the newest first words, which may go on in the next piece
    for now in pieces:
        place = np.stack([now[c].astype(np.int64) for c in (3, 4, 5)])
        new = np.append(before is None or (before != place[:, 0]).any(), (place[:, 1:] != place[:, :-1]).any(axis=0))
        before, now = place[:, -1], [x[new] for x in now]  # a row that is there twice counts once
        if not new.any():
            continue
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            out, seen = shared_windows([x[:cut] for x in now], least, seen, last, False)
            yield from out
        held = [x[cut:] for x in now]
        if len(held[0]) > most:
            out, seen = shared_windows(held, least, seen, last, True)
            yield from out
            last, held = held[1][-1].copy(), None
    if held is not None:
        yield from shared_windows(held, least, seen, last, False)[0]


def matched(dealt: DataFrame, least: int, k: int) -> DataFrame:
    left = least - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = []  # matches that a batch has found itself

        def pieces() -> Iterator[list[np.ndarray]]:
            for b in batches:
                found = b.column(5).to_numpy() < 0
                if found.any():
                    known.append(pa.record_batch([b.column(c).filter(pa.array(found)) for c in (3, 4, 6, 7, 8, 9, 10)], names=_NAMES))
                    b = b.filter(pa.array(~found))
                if b.num_rows:
                    yield [b.column(0).to_numpy(), _matrix(b.column(1), least), _matrix(b.column(2), left), *(b.column(c).to_numpy() for c in (3, 4, 5, 6))]

        for m in over_runs(pieces(), least):
            yield from known
            known.clear()
            yield m
        yield from known

    return dealt.mapInArrow(run, MATCH)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(col) else np.zeros(0, np.uint8)
    return raw.view(np.uint32).reshape(len(col), width)


def repeated_passages(docs: DataFrame, least: int = LEAST, k: int = K) -> DataFrame:
    """doc_id, n_words, n_repeated, spans (start, end) and matched_doc_ids of the documents that share a passage."""
    spark = docs.sparkSession
    rows, here = keyed(docs), ["doc", "ord"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = stored(repeated_anchors(rows, hashed, k, least, parts), "anchors")
    dealt = suffixes(rows, places, least, k).repartition(parts, "g").sortWithinPartitions("g", "right", "left", *here, "at")
    found = stored(matched(dealt, least, k), "matches")
    dropped(places)
    # A document has at most a few matches for each of its places.
    whole = found.groupBy(*here).agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("m"), F.min(F.struct("from_doc", "from_ord")).alias("f"))
    merge = """aggregate(m, cast(array() as array<struct<start:int,end:int>>), (a, x) ->
      CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).end
           THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end))))
           ELSE concat(a, array(x)) END)"""
    merged = whole.withColumn("spans", F.expr(merge))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return merged.select(doc_id().alias("doc_id"), "n_words", covered.alias("n_repeated"), "spans", doc_id("f.from_doc", "f.from_ord").alias("matched_doc_id"))


def op2_sparse_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_repeated")
