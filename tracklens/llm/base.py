"""Helpers that every operator of this subpackage shares: tables, durable intermediates, words and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.sources.durable import dropped, shared_dir, shared_file, stored  # noqa: F401

#: The characters that separate words, for Java and RE2 patterns; ``bytes.split()`` splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow functions that run inside get at most ``rows`` rows at once, for workers with little memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where the table has a column of that name."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table, written once, with a number for each row, and the column's name: rows may share a doc_id or have none."""
    row = fresh(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, ``more`` and the text as UTF-8 bytes; other columns of the table are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("binary").alias("text"))


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _odd(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit constants from a seed, by splitmix64."""
    z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive word hashes (multilinear, mixed)."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(_odd(seed, k)):
        out += h[j : j + n] * c
    return mixed(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batches(rows: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """Each batch's columns as Python lists."""
    for b in rows:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)
