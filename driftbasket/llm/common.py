"""What the operators of this subpackage share: table access, scratch tables in the shared folder, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize, materialize_by, scratch_root  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """For operators whose rows hold whole texts or sets of them: fewer rows and bytes in one Arrow batch (one row at
    least), so that a worker and its executor hold a few MB of them. Runtime settings of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more; else it waits until the driver happens
    to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, after which a worker, which Spark keeps for later tasks, gives its free memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row: a lambda variable is bound, never inlined again."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of one row of a bitmap (128 KB), and the most rows of one.
BITMAP_ROW, MOST_ROWS = 1 << 20, 1 << 10


def bitmap_of(hashes: DataFrame) -> Broadcast:
    """A broadcast bitmap that holds hashes(h): at least 64 bits for each, 128 MB at most. is_marked() says yes to all of
    them and to some others, beyond two million hashes to more of them, so exact joins follow it."""
    rows = 1
    while rows < MOST_ROWS and rows * BITMAP_ROW < 64 * hashes.count():
        rows *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            row, bit = np.divmod(b.column("slot").to_numpy(), BITMAP_ROW)
            for r in np.unique(row):
                held.setdefault(int(r), np.zeros(BITMAP_ROW, bool))[bit[row == r]] = True
        for r, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["row", "bits"])

    slots = hashes.select(F.pmod("h", F.lit(rows * BITMAP_ROW)).alias("slot"))
    slots = slots.repartition(F.floor(F.col("slot") / BITMAP_ROW)).mapInArrow(trimmed(run), "row long, bits binary")
    out = np.zeros(rows * BITMAP_ROW // 8, np.uint8)
    for r in slots.collect() if rows <= 64 else slots.toLocalIterator():
        at = r["row"] * BITMAP_ROW // 8
        out[at : at + BITMAP_ROW // 8] |= np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def is_marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % (8 * len(bitmap))
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A null text is an empty one."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def ascii_lower(text: str) -> str:
    """A-Z only, as the operators' word rules ask."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[bytes]:
    r"""Maximal runs of [^\x20\x09-\x0D], A-Z lower-cased: bytes.lower() and bytes.split() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split()
