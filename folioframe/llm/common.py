"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select columns by exact name, whatever else the frame holds.

    Spark resolves names without case, so a frame with both ``text`` and
    ``TEXT`` can't be selected from by name; columns are taken by place.
    """
    columns = df.columns
    places = [columns.index(name) for name in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioframe-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """A new folder of this application under the shared one; all of them go together (``plans.store.sweep``)."""
    return f"{shared_dir(spark)}/folioframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and read it again.

    Cuts the lineage: a lost executor costs a re-read, not a re-run.
    """
    path = f"{run_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """The frame, to be broadcast if it has at most ``rows`` rows; it must be a written one, whose count costs little."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Most rows of a few plain columns to broadcast (some 50 MB).
BROADCAST_ROWS = 500_000
#: A key is hot when it holds more than one in so many rows; so no more keys than this are hot.
HOT_SHARE = 10_000


def join_unique(big: DataFrame, unique: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, least: int = 10_000) -> DataFrame:
    """``big`` with the columns of ``unique``, a written table of one row for each key without nulls; ``how`` is inner or left.

    Up to ``rows`` rows ``unique`` is broadcast. Beyond it the keys that hold
    more than one in ``HOT_SHARE`` of ``big``'s rows (and ``least``) are
    counted, their rows of ``unique`` are broadcast (at most ``HOT_SHARE``
    of them), and only the other rows are shuffled by key, so that no hot key
    meets in one task. ``big`` is read three times then; it should be a written table too.
    """
    if unique.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(unique), on, how)
    bound = max(least, big.count() // HOT_SHARE)
    hot = materialise(big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound).select(*on), "hot-keys")
    if hot.isEmpty():
        return big.join(unique, on, how)
    of_hot = F.broadcast(unique.join(F.broadcast(hot), on, "left_semi"))
    rest = big.join(F.broadcast(hot), on, "left_anti").join(unique, on, how)
    return big.join(F.broadcast(hot), on, "left_semi").join(of_hot, on, how).unionByName(rest)


def give_back() -> None:
    """Hand the memory that this worker has freed back to the system: it waits for tasks of other stages, beside an executor that grows."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
