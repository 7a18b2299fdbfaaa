"""Staging area for tables that several jobs of one audit read.

Loops and shared views are cut by writing a parquet table to the folder that the
cluster names in ``spark.checkpoint.dir``. The files outlive any executor, give
Catalyst real sizes to plan with, and keep column pruning and filter pushdown for
the readers.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


T = TypeVar("T")
R = TypeVar("R")

# Independent jobs submitted at a time.
CONCURRENT_JOBS = 16

# Tables known to be no larger than this stay plans: redoing them beats a write.
SMALL_ROWS = 100_000


@dataclass(frozen=True)
class Stage:
    """A table for several readers, with its row count or an upper bound of it."""

    df: DataFrame
    rows: int


class Workspace:
    """Writes intermediate tables below the session's checkpoint folder."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.path = f"{(root or _shared_root(spark)).rstrip('/')}/grantlens-{uuid.uuid4().hex}"
        self._numbers = itertools.count(1)
        # What nobody closes goes when the driver ends.
        path, fs = self._location()
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def stage(
        self,
        df: DataFrame,
        name: str,
        partition_by: str | None = None,
        at_most: int | None = None,
    ) -> Stage:
        """Write ``df`` once and return the stored table.

        The row count is observed during the write, so size checks cost no job. With a
        proven bound ``at_most`` that is small, the table is left a plan.
        """
        if at_most is not None and at_most <= SMALL_ROWS:
            return Stage(df, at_most)
        path = f"{self.path}/{next(self._numbers):03d}-{name}"
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return Stage(self.spark.read.schema(df.schema).parquet(path), seen.get["rows"])

    def _location(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def close(self) -> None:
        """Drop the staged tables; call once nothing lazy reads them any more."""
        path, fs = self._location()
        fs.delete(path, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


def _shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or else a warehouse that was named.

    Driver and executors must share it. Without either only a local session has such a folder of its own.
    """
    named = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or named.get("spark.sql.warehouse.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir")


def side_by_side(spark: SparkSession, action: Callable[[T], R], items: Iterable[T]) -> list[R]:
    """Run an action that submits jobs for several items at a time; results in order."""
    run = inheritable_thread_target(spark)(action)
    with ThreadPoolExecutor(CONCURRENT_JOBS) as pool:
        return list(pool.map(run, items))
