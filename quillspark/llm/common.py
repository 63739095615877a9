"""What the operators share: fixed tables of bytes, bounded samples, what workers keep; written tables come from the library."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import saved

__all__ = ["WORD_BYTES", "bounded_batches", "bounded_sample", "crc_bucket", "kept", "saved", "text_of", "tidy"]

#: Bytes to bytes: A-Z lower-cased, every other ASCII byte but digits and a-z to a blank. Bytes of non-ASCII characters stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

#: What this Python worker keeps between tasks, by operator and key.
_KEPT: dict[tuple[str, str], object] = {}


def kept(owner: str, key: str, make: Callable[[], object]):
    """What `make` gives, once a worker, for the tasks of the operator `owner`; tasks of others that are `tidy` drop it."""
    if (owner, key) not in _KEPT:
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]


def tidy(owner: str) -> Callable:
    """Decorator of a task's function from batches to batches.

    A worker serves the tasks of all operators in turn. Before such a task it drops what it keeps for others than `owner`,
    and afterwards it gives the memory that has become free back to the machine.
    """

    def of(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @wraps(run)
        def tidied(batches):
            _drop_others(owner)
            yield from run(batches)
            _give_back()

        return tidied

    return of


def _drop_others(owner: str) -> None:
    """A function of its own, as one that is sent to a worker would bring a copy of `_KEPT`."""
    for other in [name for name in _KEPT if name[0] != owner]:
        del _KEPT[other]


def _give_back() -> None:
    """Free memory that Arrow and the C library (where it is glibc) hold goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Let a batch that goes to Python hold about `megabytes` of rows from now on (a setting of the session).

    Whole texts otherwise go 10,000 rows (up to 64 MB) at a time, which a task holds in the JVM, in transfer and in Python.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def bounded_sample(frame: DataFrame, key: str, bound: int, seed: int = 17) -> DataFrame:
    """About `bound` rows at most, chosen by a hash of `key` alone; all rows when there are no more than `bound`."""
    total = frame.count()
    if total <= bound:
        return frame
    share = int(bound / total * (1 << 30))
    return frame.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < share)
