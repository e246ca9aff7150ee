"""Tables in the folder that driver and executors share, and stable numbering."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def in_one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are this process, so that they share its folders."""
    return re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session in one process gets a temporary folder, once;
    a cluster is an error, as its executors would not see a folder of the driver's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.brindle.shared.dir", None)
    if not named:
        if not in_one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = Path(tempfile.mkdtemp(prefix="brindle-")).as_uri()
        spark.conf.set("spark.brindle.shared.dir", named)
    return named.rstrip("/")


#: What a Python worker is sent at once, at most (a longer row comes alone).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside is sent to Python workers in small batches, so that they hold little of a table of any size."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it again: computed once, lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/brindle/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordinal(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Add ``name``: 0, 1, ... in the given total order, without sorting in one task.

    Rows are dealt out by range, numbered within their range, and shifted by
    the sizes of the ranges before.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shift = ranged.groupBy("_range").count().withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_range", "_shift")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn(name, within).join(F.broadcast(shift), "_range").withColumn(name, (F.col(name) + F.col("_shift")).cast("long")).drop("_range", "_shift")


def workers_import_this(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it.

    Workers on the driver's machine see its files; a cluster's executors get the
    package as an archive, once a session.
    """
    root, package = Path(__file__).resolve().parents[1], __package__.split(".")[0]
    if spark.conf.get("spark.master", "").startswith("local"):
        env = spark.sparkContext.environment
        known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(root) not in known:
            env["PYTHONPATH"] = os.pathsep.join([str(root), *known])
    elif not spark.conf.get("spark.brindle.shipped", None):
        folder = tempfile.mkdtemp(prefix="brindle-")  # the driver serves the archive
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package}", "zip", root, package))
        spark.conf.set("spark.brindle.shipped", "true")
