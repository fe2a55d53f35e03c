"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side smaller than this many bytes may be broadcast; a larger one takes the shuffled path.
BROADCAST_BYTES = 64 << 20

_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8: runs of ASCII letters, digits and any non-ASCII characters."""
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split() if text else []


class Memo(dict):
    """A dict that computes missing values and empties itself at `cap` entries, so its memory is bounded."""

    def __init__(self, fn: Callable[[Any], Any], cap: int = 300_000):
        super().__init__()
        self.fn, self.cap = fn, cap

    def __missing__(self, key: Hashable) -> Any:
        if len(self) >= self.cap:
            self.clear()
        self[key] = v = self.fn(key)
        return v


def tidy(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """`f` for mapInPandas, with the memory that it freed given back to the system at its end: workers live on for other tasks and stages."""

    def g(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ctypes

        import pyarrow as pa

        yield from f(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return g


def word_hash(w: bytes) -> int:
    """A hash of a word in 63 bits, the same in every process."""
    return xxhash.xxh64_intdigest(w) >> 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, a temporary folder, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="vexarium-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"vexarium-{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_within(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the (already materialised) table is small enough to broadcast."""
    return df.count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its measured size allows it; else Spark joins by shuffle."""
    return F.broadcast(df) if rows_within(df, row_bytes, limit) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
