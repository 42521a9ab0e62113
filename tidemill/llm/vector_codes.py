"""Vector compression: each of a vector's parts is replaced by the number of the nearest entry of a codebook.

Components become integers, so sums, means and ties are the same however the rows are dealt. Tasks turn
their rows into columnar blocks, one line of numbers for each dimension; each round is a treeAggregate over
the blocks: distances to the entries add up dimension by dimension, and sums and counts of the parts of each
entry (tensors of some KB, whatever the input) merge in a tree of tasks. The driver holds the codebooks alone.

Defined results
* vectors that are null, empty, or hold null or non-finite components are dropped; so are those of another
  length than the kept vector with the smallest id (vectors of mixed lengths have no common parts).
* the first entries are the parts of the rows with the smallest ids; ties go by the vector, null ids come
  last; with fewer rows than entries there are fewer entries. Repeated rows count each and may begin equal entries; ties
  of distances go to the lower entry, so a repeated entry stays unused and as it is.
* a null id stays null; null labels are one label; other columns are ignored; an empty table gives none.
* lengths that the number of parts does not divide end in a ValueError, components so large that squared
  distances leave 64 bits in an OverflowError: neither has a right result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpoint, small_batches

#: Numbers of a block at most; a block is worked on at a time, with a line of distances for each entry.
BLOCK_NUMBERS = 1 << 18
#: From so many partitions on, sums merge over three levels and not two.
WIDE = 1000
#: Labels whose sums go to every task; more of them are joined by a shuffle.
FEW_LABELS = 10_000


@dataclass
class Codebooks:
    """entries[part, entry, position] and what turns a component into an integer."""

    entries: np.ndarray
    scale: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _finite(vectors: DataFrame, id_column: str, vector_column: str, *more: str) -> DataFrame:
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("vector"), *(F.col(c).alias(f"more_{k}") for k, c in enumerate(more)))
    return rows.where(F.coalesce(F.size("vector") > 0, F.lit(False))).where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """[dimension, row]: floor(scale * x)."""
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    if scaled.size and np.abs(scaled).max() > math.isqrt((1 << 61) // width):
        raise OverflowError("squared distances of such large components leave 64 bits")
    return np.ascontiguousarray(scaled.reshape(-1, width).T.astype(np.int64))


def _nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes[part, row] and each row's squared distances, summed over the parts."""
    parts, count, width = entries.shape
    rows = block.shape[1]
    codes, errors = np.empty((parts, rows), np.int64), np.zeros(rows, np.int64)
    for p in range(parts):
        away = np.zeros((count, rows), np.int64)
        for d in range(width):
            apart = block[p * width + d] - entries[p, :, d, None]
            away += apart * apart
        codes[p] = away.argmin(axis=0)  # the first of equal ones
        errors += away.min(axis=0)
    return codes, errors


def _blocks(width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_NUMBERS // width)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                block = _integers(batch.column(0).slice(start, step), width, scale)
                small = np.int32 if np.abs(block).max() < 1 << 31 else np.int64
                yield pa.record_batch([pa.array([block.astype(small).tobytes()]), pa.array([block.shape[1]])], names=["numbers", "n"])

    return run


def _unpack(row, width: int) -> np.ndarray:
    kind = np.int32 if len(row["numbers"]) == 4 * width * row["n"] else np.int64
    return np.frombuffer(row["numbers"], kind).reshape(width, row["n"]).astype(np.int64)


def train(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all rows (id, vector); None without rows."""
    first = rows.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["vector"])
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("vector") == width)
    if any(len(r["vector"]) != width for r in first):
        first = rows.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect()
    begun = _integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width, scale)
    books = np.ascontiguousarray(begun.reshape(parts, width // parts, -1).transpose(0, 2, 1))
    small_batches(rows.sparkSession)
    blocks = checkpoint(rows.select("vector").mapInArrow(_blocks(width, scale), "numbers binary, n long")).rdd
    context, each = rows.sparkSession.sparkContext, width // parts
    depth = 3 if blocks.getNumPartitions() > WIDE else 2
    for _ in range(rounds):
        shared = context.broadcast(books)  # parts * entries * width numbers

        def add(state, row, shared=shared):
            sums, counts = state
            block = _unpack(row, width)
            codes, _ = _nearest(block, shared.value)
            for p in range(parts):
                np.add.at(counts[p], codes[p], 1)
                for d in range(each):
                    np.add.at(sums[p, d], codes[p], block[p * each + d])
            return sums, counts

        def merge(a, b):
            return a[0] + b[0], a[1] + b[1]

        zero = (np.zeros((parts, each, books.shape[1]), np.int64), np.zeros((parts, books.shape[1]), np.int64))
        sums, counts = blocks.treeAggregate(zero, add, merge, depth)
        means = sums // np.maximum(counts, 1)[:, None, :]  # floors
        books = np.ascontiguousarray(np.where(counts[:, :, None] > 0, means.transpose(0, 2, 1), books))
        shared.unpersist()
    return Codebooks(books, scale)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """rows (id, vector, ...) without the vector, with code (two hex digits a part) and error."""
    parts, _, each = books.entries.shape
    width, scale = parts * each, books.scale
    shared = rows.sparkSession.sparkContext.broadcast(books.entries)
    rows = rows.where(F.size("vector") == width)
    kept = [c for c in rows.columns if c != "vector"]
    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_NUMBERS // width)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                codes, errors = _nearest(_integers(batch.column("vector"), width, scale), shared.value)
                text = np.ascontiguousarray(codes.T.astype(np.uint8)).tobytes().hex()
                text = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(text, pa.string()), pa.array(errors)], names=[*kept, "code", "error"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"{rest}, code string, error long")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with a column `vector`: the entries that the codes name, as components."""
    parts, count, _ = books.entries.shape
    table = F.array(*(F.array(*(F.array(*(F.lit(x / books.scale) for x in e.tolist())) for e in part)) for part in books.entries))
    at = lambda k: F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")
    return coded.withColumn("vector", F.flatten(F.array(*(table[k][at(k)] for k in range(parts)))))


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """id, label, code, error, label_error (errors of all rows with the label) and codebooks_sha256 of every kept row."""
    if not 1 <= entries <= 256:
        raise ValueError("a part's code has two hex digits: 1 to 256 entries")
    rows = _finite(vectors, id_column, vector_column, label_column)
    books = train(rows, parts, entries, rounds, scale)
    if books is None:
        coded = rows.select("id", "more_0", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = checkpoint(encode(rows, books))
    totals = checkpoint(coded.groupBy(F.col("more_0").alias("of")).agg(F.sum("error").alias("label_error")))
    # two numbers a label; beyond that a shuffled join, whose hot labels adaptive execution splits
    totals = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    done = coded.join(totals, F.col("more_0").eqNullSafe(F.col("of")))
    sha = F.lit(books.sha256 if books else hashlib.sha256(b"").hexdigest())
    return done.select(F.col("id").alias(id_column), F.col("more_0").alias(label_column), "code", "error", "label_error", sha.alias("codebooks_sha256"))
