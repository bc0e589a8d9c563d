"""Encoding and decoding with a SentencePiece vocabulary of merge type.

The model file gives pieces with scores. A text begins with one space mark, and blanks are space marks too. It is split
where no piece of the vocabulary could reach across, which is proved from the vocabulary: before a space mark that
follows another character, and between characters that no chain of pieces joins. Each part is merged on its own: an agenda
holds the adjacent pairs of symbols whose joined text is a piece, the highest score first, the leftmost of equal ones;
pairs that an earlier merge has changed are passed over. A character without a piece becomes its UTF-8 bytes. The ids and
the decoded text of short parts are kept in each Python worker, at most ``KEPT`` parts.

Rows stay where they are read: no shuffle, no state beyond one Arrow batch of ``BATCH`` texts and the kept parts. With
``check`` the installed library encodes and decodes, batch by batch, every part that was merged, and ``agrees`` says
whether ids and text of all parts of a text are equal. That parts are independent follows from the vocabulary.

Defined cases: a null text is an empty one, without ids; repeated rows give repeated rows; a null doc_id stays null; other
columns aren't read. Vocabularies with user-defined or unused pieces, without byte fallback, with a normalizer or without
the mark in front are refused, since their rules differ.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import batches, id_and_text, small_batches, stored, table

MARK = "▁"
#: Texts in an Arrow batch; parts that a worker keeps twice over, and the longest part kept in characters: some 220 MB.
BATCH, KEPT, LONGEST = 500, 500_000, 48
WHOLE = r"(?s).+"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return n, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else number(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def joined_characters(pieces: Iterable[str]) -> list[set[str]]:
    """The families of characters that pieces of two or more characters join, directly or through others."""
    family: dict[str, set[str]] = {}
    for piece in pieces:
        if len(piece) > 1 or piece in family:
            one = set(piece).union(*(family.get(c, ()) for c in piece))
            family.update(dict.fromkeys(one, one))
        elif piece:
            family[piece] = {piece}
    return list({id(f): f for f in family.values()}.values())


class Pieces:
    """The vocabulary of a model file and what follows from it."""

    def __init__(self, model: bytes):
        self.names: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        spec: dict[int, dict] = {2: {}, 3: {}}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field in spec:
                spec[field] = dict(_fields(value))
        trainer, norm = spec[2], spec[3]
        plain = trainer.get(3, 1) == 2 and trainer.get(35, 0) == 1 and not trainer.get(24, 0)  # merges, byte fallback, marks in front
        plain &= not norm.get(2) and norm.get(3, 1) == 1 and norm.get(4, 1) == 0 and norm.get(5, 1) == 1  # nothing mapped or removed
        if not plain or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a vocabulary of merge type with byte fallback, without a normalizer, is needed")
        self.ids = {p: i for i, p in enumerate(self.names) if self.kinds[i] == NORMAL}
        ranks = {x: r for r, x in enumerate(sorted({-scores[i] for i in self.ids.values()}))}
        self.rank = {p: ranks[-scores[i]] for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.names) if self.kinds[i] == BYTE}
        self.bytes = {i: b for b, i in self.byte.items()}
        long = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in long):
            self.part = re.compile(WHOLE)
        else:
            # Marks with the characters after them that pieces join, marks alone, or one character that no longer piece has.
            families = "|".join(f"[{''.join(map(re.escape, sorted(f)))}]+" for f in joined_characters(p.lstrip(MARK) for p in long))
            self.part = re.compile(rf"(?s){MARK}*(?:{families})|{MARK}+|." if families else rf"(?s){MARK}+|.")
        # One character that joins no other, to set parts apart where the library encodes many at once.
        apart = set("".join(long))
        self.gap = next((c for c in map(chr, range(10, 32)) if c not in apart and c not in self.ids), None)
        # Ids of parts joined by commas; parts that decode to another text than their own; parts that the library has otherwise.
        self.now: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.wrong: set[str] = set()

    def merged(self, part: str) -> list[str]:
        """The symbols of a part once no adjacent pair is a piece."""
        symbol, rank_of = list(part), self.rank.get
        n = len(symbol)
        # The rank of the pair of each symbol and the one after it; an entry of the agenda that differs is out of date.
        now = [*(rank_of(x + y) for x, y in zip(symbol, symbol[1:])), None]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r << 32 | i for i, r in enumerate(now) if r is not None]
        heapq.heapify(agenda)
        while agenda:
            best = heapq.heappop(agenda)
            a = best & 0xFFFFFFFF
            if now[a] != best >> 32:
                continue
            b = right[a]
            symbol[a] += symbol[b]
            symbol[b], now[b] = "", None
            after = right[a] = right[b]
            if after < n:
                left[after] = a
                r = now[a] = rank_of(symbol[a] + symbol[after])
                if r is not None:
                    heapq.heappush(agenda, r << 32 | a)
            else:
                now[a] = None
            before = left[a]
            if before >= 0:
                r = now[before] = rank_of(symbol[before] + symbol[a])
                if r is not None:
                    heapq.heappush(agenda, r << 32 | before)
        return [s for s in symbol if s]

    def with_bytes(self, symbols: list[str]) -> list[int]:
        """The ids of symbols; those without a piece as bytes."""
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            out += [self.byte[b] for b in s.encode()] if i is None else [i]
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of ids with marks as blanks; runs of bytes together, each wrong byte as U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(_from_bytes(bytes(run)))
                run.clear()
            if i is not None and self.kinds[i] != CONTROL:
                out.append(" ⁇ " if self.kinds[i] == UNKNOWN else self.names[i].replace(MARK, " "))
        return "".join(out)

    def of_part(self, part: str) -> tuple[list[int], str]:
        """The ids of a part and the text that they decode to."""
        symbols = self.merged(part)
        ids = [self.ids.get(s) for s in symbols]
        if None not in ids:
            return ids, part.replace(MARK, " ")  # pieces decode to the symbols that they were found by
        ids = self.with_bytes(symbols)
        return ids, self.decoded(ids)

    def run(self, texts: list[str], check=None) -> list[tuple[str, int, str, bool]]:
        """Of each text the ids joined by commas, their number, the text that they decode to, and whether all parts agree.

        The blank that stands for the mark in front is not part of the decoded text. ``check``: the library's processor.
        """
        split = [self.part.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.now) > KEPT:
            self.before, self.now = self.now, {}
        new, now, before = [], self.now, self.before
        for p in set().union(*split).difference(now):
            if (known := before.get(p)) is None:
                ids, text = self.of_part(p)
                new.append((p, ids, text))
                known = ",".join(map(str, ids))
                if text != p.replace(MARK, " "):
                    self.odd[p] = text
            now[p] = known
        if check is not None and new:
            self.wrong.update(self.differing(new, check))
        out = []
        for parts in split:
            ids = ",".join(map(now.__getitem__, parts))
            text = "".join(parts).replace(MARK, " ") if self.odd.keys().isdisjoint(parts) else "".join([self.odd.get(p) or p.replace(MARK, " ") for p in parts])
            out.append((ids, ids.count(",") + 1 if ids else 0, text[1:], self.wrong.isdisjoint(parts)))
        for p, *_ in new:
            if len(p) > LONGEST:
                del now[p]
                self.odd.pop(p, None)
        return out

    def differing(self, new: list[tuple[str, list[int], str]], library) -> list[str]:
        """The parts whose ids or text the library has otherwise.

        It encodes all of them in one text, set apart by a character that joins no other; should that differ, one by one.
        """
        mark, gap = self.with_bytes([MARK]), self.with_bytes([self.gap]) if self.gap else []

        def same(some: list[tuple[str, list[int], str]]) -> bool:
            text = "".join(self.gap + p for p, *_ in some).replace(MARK, " ")
            ids = mark + [i for _, own, _ in some for i in (*gap, *own)]
            return library.encode(text) == ids and library.decode(ids) == "".join(self.gap + t for *_, t in some)

        if not self.gap or self.part.pattern == WHOLE:  # parts are whole texts
            return [p for p, ids, t in new if library.encode(p[1:].replace(MARK, " ")) != ids or library.decode(ids) != t[1:]]
        some = [x for x in new if self.gap not in x[0]]
        return [] if same(some) else [x[0] for x in some if not same([x])]


def _from_bytes(data: bytes) -> str:
    """UTF-8 as text; each byte that isn't part of a valid character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """Once in each Python worker."""
    return Pieces(model)


@lru_cache(maxsize=2)
def library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def model_bytes(path: str) -> bytes:
    """A model file, which the driver reads and sends with the tasks: about half a megabyte, at most 8."""
    with open(path, "rb") as f:
        data = f.read((8 << 20) + 1)
    if len(data) > 8 << 20:
        raise ValueError("a model file may have at most 8 MB")
    return data


def encoded(docs: DataFrame, model: bytes, check: bool = True, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, with ``check`` also agrees, with ``ids`` also ids and decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", agrees boolean" * check + ", ids array<int>, decoded string" * ids

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        gc.disable()  # many small objects and no cycles: the collector took a third of the time
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        try:
            for doc, raw in batches(rows, "doc_id", "text"):
                texts = [(t or b"").decode(errors="replace") for t in raw]
                made = own.run(texts, library(model) if check else None)
                columns = [pa.array(doc, pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([sha(m[0]) for m in made]), pa.array([sha(m[2]) for m in made])]
                if check:
                    columns.append(pa.array([m[3] for m in made], pa.bool_()))
                if ids:
                    columns += [pa.array([[int(i) for i in m[0].split(",") if i] for m in made], pa.list_(pa.int32())), pa.array([m[2] for m in made])]
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["agrees"] * check, *["ids", "decoded"] * ids])
        finally:
            gc.enable()

    return id_and_text(docs).mapInArrow(run, schema)


def decoded(tokens: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text, ids outside the vocabulary raise."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for doc, ids in batches(rows, "doc_id", "ids"):
            texts = [own.decoded(i or []) for i in ids]
            # The mark in front isn't text, if a piece with a mark comes first.
            texts = [t[1:] if i and own.names[i[0]].startswith(MARK) else t for t, i in zip(texts, ids, strict=True)]
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and whether the library agrees."""
    import public_tokenizers

    model = model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    with small_batches(spark, BATCH):
        return stored(encoded(table(spark, sf_dir, "documents"), model), "pieces")
