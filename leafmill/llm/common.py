"""What the operators share: tables, the shared folder, files in it, words and hashes."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..tables import BROADCAST_BYTES, open_fs, shared_dir, small, stash, write_atomically

__all__ = ["BROADCAST_BYTES", "crc_mod", "mix64", "open_fs", "read", "shared_dir", "small", "stash", "text_words", "tidy", "tune", "write_atomically"]

#: Rows of an Arrow batch: whole texts are long, so the default of 10,000 could take gigabytes.
ARROW_ROWS = 512

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def text_words(text: str | None) -> list[bytes]:
    """UTF-8 words: runs of digits, letters and all that isn't ASCII, with A-Z lowered."""
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def tidy(run, forget=None):
    """`run` (a function of a task's batches) with what the task has freed given back to the system at its end.

    Python workers outlive their tasks, and several operators run in one worker after the other. forget: a function of a
    module that empties what that module remembers.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            _give_back()

    return tidied


def _give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)
