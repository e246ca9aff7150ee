"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the contracts define it: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def in_one_process(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``.  Where that is
    unset and the session runs in this one process (tests, a laptop) one
    temporary folder is made and kept in the session's settings, so that every
    operator of a session uses the same one.  A cluster without the setting is
    an error: its executors would not see a folder of the driver's machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.brindle.shared.dir", None)
    if not named:
        if not in_one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = Path(tempfile.mkdtemp(prefix="brindle-")).as_uri()
        spark.conf.set("spark.brindle.shared.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage as ``checkpoint`` does, but computes the plan once and
    keeps columns prunable.  The table outlives any executor.
    """
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers_import_this(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it.

    Masters on this machine see the driver's own files; a cluster's executors
    get the package as an archive, once a session.
    """
    root = Path(__file__).resolve().parents[2]
    if spark.conf.get("spark.master", "").startswith("local"):
        env = spark.sparkContext.environment
        known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(root) not in known:
            env["PYTHONPATH"] = os.pathsep.join([str(root), *known])
    elif not spark.conf.get("spark.brindle.shipped", None):
        folder = tempfile.mkdtemp(prefix="brindle-")  # the driver serves the archive to the executors
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{__package__.split('.')[0]}", "zip", root, __package__.split(".")[0]))
        spark.conf.set("spark.brindle.shipped", "true")


_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task, one thing at a time.

    Spark gives a worker to whatever stage runs next, so a memory of one
    operator would stay with it while another has its own.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


@contextlib.contextmanager
def settings_of(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as ``__``) for what is computed inside, put back afterwards."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Each row of ``df`` as the struct ``r``, with ``_file`` and ``_row``: where it lies in its Parquet files.

    Inside the struct, columns may have any name.  A frame that isn't a plain
    file scan has no such place, so it is written to the shared folder first.
    """

    def placed(frame: DataFrame) -> DataFrame:
        place = frame.metadataColumn("_metadata")
        return frame.select(F.struct(*named(frame.columns)).alias("r"), place["file_path"].alias("_file"), place["row_index"].alias("_row"))

    try:
        found = placed(df)
        found.schema  # noqa: B018  resolves the place, or fails
        return found
    except AnalysisException:
        return placed(materialize(spark, df, "located"))


def of_row(name: str) -> Column:
    """A column of a ``located`` row, by its exact name."""
    return F.col("r").getField(name)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def normalised_schema(schema: T.StructType) -> T.StructType:
    """The schema as Parquet gives it back: every field may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
