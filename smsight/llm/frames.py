"""Small helpers that the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from smsight.session import scratch_path, written  # noqa: F401  (operators take them from here)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished jobs now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables that one computation writes into the shared folder and deletes at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table, read it back, and let go of the shuffles that it took."""
        self.paths.append(scratch_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        """Delete all tables; only for what nothing reads any more."""
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = []


def by_slices(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """mapInArrow over slices of bounded text size; ``work`` returns one batch for each, or None."""
    from smsight.llm.words import slices

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices((b.rename_columns(names) for b in batches), column):
            out = work(part)
            if out is not None and out.num_rows:
                yield out

    # mapInArrow takes no column whose name holds a dot
    return (df.toDF(*(f"c{i}" for i in range(len(names)))) if any("." in c for c in names) else df).mapInArrow(run, schema)


def least_hash(hashes: DataFrame, rows: int) -> int | None:
    """The hash up to which ``rows`` distinct ones of a column of hashes lie: a bounded sample without moving texts."""
    least = hashes.toDF("h").where("h IS NOT NULL").distinct().orderBy("h").limit(rows)
    return least.agg(F.max("h").alias("h")).first()["h"]


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def lists(values, begins, kind: pa.DataType) -> pa.Array:
    """A list column over flat values; ``begins`` has one entry more than there are lists."""
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values, kind))
