"""What the operators of this package share: scratch tables and Arrow batch size."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.scratch import materialize, scratch, settled, shared_dir, swept
from textloom.session import BATCH_BYTES, bound_batches

__all__ = ["BATCH_BYTES", "BROADCAST_ROWS", "bound_batches", "bounded", "materialize", "scratch", "settled", "shared_dir", "swept", "trim"]

#: Rows of a small table up to which it is broadcast; a greater one is shuffled.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if its ``rows``, which were counted, are at most BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def trim() -> None:
    """Give free memory back to the machine: Python workers live on after a task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
