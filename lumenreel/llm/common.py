"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; one below the warehouse, which is shared too, where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield fn(b)

    return df.mapInArrow(run, schema)


def columns_of(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Columns of df by name, whatever stands in the names."""
    return [df["`" + c.replace("`", "``") + "`"] for c in (df.columns if names is None else names)]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with no column of df, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def keep_columns(df: DataFrame, new: list[str]) -> list[str]:
    """The columns of df that no new column replaces."""
    replaced = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in replaced]


MASK64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the links (a[i], b[i])."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, low, high = a[open_], b[open_], np.minimum(la, lb)[open_], np.maximum(la, lb)[open_]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def text_bytes(df: DataFrame, column: str = "text"):
    return F.col(column).cast("binary")
