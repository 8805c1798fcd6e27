"""What the operators of this subpackage share: sessions, tables, worker state and ragged arrays."""

from __future__ import annotations

import gc
import sys
import types

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from bookflow.settings import configure

#: Rows in one Arrow batch: whole texts travel in them, so a batch must stay small in bytes too.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "1.0")     # broadcasts here are of known, small tables
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole supplied table."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state(name: str, make):
    """A value made once in a Python worker process and kept between its tasks.

    Functions of this package travel by value, so their module globals live for one task only.
    """
    holder = sys.modules.setdefault("_bookflow_worker_state", types.ModuleType("_bookflow_worker_state"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def forget_worker_state() -> None:
    """Give the memory of other operators' caches back before a stage that doesn't use them."""
    if sys.modules.pop("_bookflow_worker_state", None) is not None:
        gc.collect()


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have yet (whatever the case of its own)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + length - 1`` of every piece, one after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - ends + lengths, lengths)


def group_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values[start:end]`` for every pair; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def piece_hashes(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every piece ``symbols[start:start + length]``; no piece may be empty.

    The pieces must not overlap and must come in order.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int(lengths.max())
    with np.errstate(over="ignore"):
        powers = mix(np.arange(longest, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)
        at = ragged(starts, lengths)
        within = np.arange(len(at), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        values = (symbols[at].astype(np.uint64) + np.uint64(1)) * powers[within]
        sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
        return mix(sums + lengths.astype(np.uint64))
