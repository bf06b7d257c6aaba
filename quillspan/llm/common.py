"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import workers
from quillspan.functions.storage import fresh_path, settle, shared_dir  # noqa: F401  the operators take them from here

#: The fixed word rule: maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near-uniform bits from distinct numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Rows up to which a table is sent to every executor.
BROADCAST_ROWS = 500_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled or short table, to be broadcast if its counted rows allow that; else Spark joins it by a shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


#: Rows that a Python worker gets at a time: few enough for a batch of very long texts.
BATCH_ROWS = "512"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    workers.ship(spark)
