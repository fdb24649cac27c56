"""Staged tables: steps of a job written to the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of how many folders a task writes to at once; with two, rows of GOING need no sort.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: The last column of a staged table whose rows part: true for rows that go on, which spent() deletes when the next step has them.
GOING = "_going"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a local session without it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths of tables that staged() wrote and that are still there.
STAGED: set[str] = set()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: what comes after does not compute it again, not even when executors are lost.

    Shuffle files that this step alone needed go when it ends; without that, disk fills with what no later step reads.
    With a column GOING, rows that go on lie in a folder of their own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (CLEANUP, WRITERS)}
    spark.conf.set(CLEANUP, "true")
    writer = df.write
    if GOING in df.columns:
        spark.conf.set(WRITERS, "2")
        writer = writer.partitionBy(GOING).option("compression", "zstd")
    try:
        writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path  # type: ignore[attr-defined]
    STAGED.add(path)
    return out


def parted(df: DataFrame, going: Column, on: Sequence[str | Column], over: Sequence[str | Column]) -> DataFrame:
    """What to stage of rows that part: the columns `on` of those that go on and `over` of all others (a null is one of them)."""
    goes = F.coalesce(going, F.lit(False))
    return df.select(F.when(goes, F.struct(*on)).alias("on"), F.when(~goes, F.struct(*over)).alias("over"), goes.alias(GOING))


def parts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a staged parted() that go on, and the others."""
    return table.where(GOING).select("on.*"), table.where(f"not {GOING}").select("over.*")


def spent(table: DataFrame) -> None:
    """Delete the rows of a staged table that went on, when no later step reads them, nor the result."""
    delete(table.sparkSession, f"{table.staged_path}/{GOING}=true")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    STAGED.discard(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete every table that this driver has staged and not deleted yet. A result reads its last staged tables, so call this when results are written."""
    for path in list(STAGED):
        delete(spark, path)
