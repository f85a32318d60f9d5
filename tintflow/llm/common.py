"""What the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, delete, ensure_checkpoint_dir

__all__ = ["crc_fold", "cut", "delete", "ensure_checkpoint_dir", "in_fold", "numbered", "table", "tidy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, names: dict[str, str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with columns under the given names, and c0, c1, ... for the others, so that none clashes with what is added; and what gives them back."""
    new = [names.get(c, f"c{i}") for i, c in enumerate(df.columns)]
    return df.toDF(*new), lambda out: out.select(*new).toDF(*df.columns)


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """True in the held-out fold. A row without a key is never learned from, so it counts as held out."""
    return F.coalesce(crc_fold(key, folds) == F.lit(fold), F.lit(True))


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that gives freed memory back to the system when a task ends: workers stay alive between tasks, beside the executor's heap."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run
