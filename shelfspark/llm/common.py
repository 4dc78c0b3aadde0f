"""What several operators share: work tables, the hold-out split, fixed-size tables over hash buckets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import work_folder, write_and_reread

# White space of the text contracts: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
CHUNK = 1 << 16


class WorkTables:
    """Numbered Parquet tables of one run in the cluster's shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.root = f"{work_folder(spark)}-{name}"
        self.count = 0

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}"

    def cut(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` as a written table: lineage ends here, on storage that outlives executors."""
        return write_and_reread(df, self.path())


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the key's text mod 5 is 0; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sparse_chunks(counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(chunk number, 16-bit offsets, 32-bit counts) of a bucket table's entries that are not zero."""
    for chunk in range(0, len(counts), CHUNK):
        part = counts[chunk : chunk + CHUNK]
        at = np.flatnonzero(part)
        if len(at):
            yield chunk // CHUNK, at.astype("<u2").tobytes(), part[at].astype("<u4").tobytes()


SKETCH = "chunk int, places binary, amounts binary"


def gather_buckets(parts: DataFrame, bits: int) -> np.ndarray:
    """Sums sketch rows of all tasks into one table of 2**bits counters.

    The chunks are summed on the executors; the driver receives one row per chunk, so its load
    depends on ``bits`` alone.
    """

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for places, amounts in zip(table["places"], table["amounts"], strict=True):
            total[np.frombuffer(places.as_py(), "<u2")] += np.frombuffer(amounts.as_py(), "<u4")
        total = np.minimum(total, 0xFFFFFFFF).astype("<u4")
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "amounts": pa.array([total.tobytes()])})

    counts = np.zeros(1 << bits, np.uint32)
    summed = parts.select("chunk", "places", "amounts").groupBy("chunk").applyInArrow(add, "chunk int, amounts binary")
    for row in summed.collect():
        counts[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.amounts, "<u4")
    return counts


def bucket_of(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(values) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Bitmap:
    """Which of 2**bits hash buckets some values touch, packed.

    A filter of fixed size in front of a join: a clear bucket proves absence, a set one proves nothing.  As the
    data outgrow it, it stops pruning but never drops a row.
    """

    packed: bytes
    bits: int

    def test(self, values: np.ndarray) -> np.ndarray:
        at = bucket_of(values, self.bits)
        return (np.frombuffer(self.packed, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(values: DataFrame, bits: int = 24) -> Bitmap:
    """The bitmap of the one long column of ``values``; the driver receives at most 2**bits / 8 bytes."""
    width = CHUNK // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[bucket_of(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64), bits)] = True
        chunks = seen.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(axis=1))
        packed = [np.packbits(chunks[i], bitorder="little").tobytes() for i in some]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(some, pa.int32()), "marks": pa.array(packed, pa.binary())})

    def unite(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint8)
        for marks in table["marks"]:
            total |= np.frombuffer(marks.as_py(), np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([total.tobytes()])})

    schema = "chunk int, marks binary"
    packed = bytearray((1 << bits) // 8)
    for row in values.select(values.columns[0]).mapInArrow(mark, schema).groupBy("chunk").applyInArrow(unite, schema).collect():
        packed[row.chunk * width : (row.chunk + 1) * width] = row.marks
    return Bitmap(bytes(packed), bits)
