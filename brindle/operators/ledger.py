"""Every attempt at a trial, kept for good, and what they come to.

Attempts are only appended, each as soon as it ended, so a run that is cut short
loses none and two runs overwrite nothing of each other.  What a trial's result
is, is decided when the attempts are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import SCORED, null_strict_sum

COLUMNS = "request_hash string, task string, condition string, attempt long, outcome string, input_tokens long, output_tokens long, cost_usd double, wall_ms double, error string, id string"
USAGE = ("input_tokens", "output_tokens", "cost_usd")


def append(spark: SparkSession, root: str, rows: list[dict]) -> None:
    """Add attempts; what a row doesn't say is null."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    made = [tuple({"id": uuid.uuid4().hex, **r}.get(n) for n in names) for r in rows]
    spark.createDataFrame(made, COLUMNS).coalesce(1).write.mode("append").parquet(root)


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """All attempts; none if there is no ledger yet."""
    spark.createDataFrame([], COLUMNS).coalesce(1).write.mode("append").parquet(root)
    return spark.read.schema(COLUMNS).parquet(root)


def merged(rows: DataFrame, scored: Column | None = None) -> DataFrame:
    """A row for each request_hash: the first scored attempt, else the last one, with ``attempts``, their number, and their usage.

    Attempts are in order of ``attempt``, then ``id``; a scored one ends a
    trial, what comes after it is only counted.  ``total_<counter>`` is null if
    any attempt's counter is.  Rows of one request are combined in the tasks
    that read them, so a trial may have any number of attempts.
    """
    scored = F.col("outcome").isin(*SCORED) if scored is None else scored
    order = F.struct("attempt", "id")
    # scored ones first and the earliest of them, then the latest of the others
    rows = rows.withColumns({"_scored": F.coalesce(scored, F.lit(False)), "_at": order})
    kept = [c for c in rows.columns if c not in ("_scored", "_at", "request_hash")]
    best = {"first": F.min_by(F.struct(*kept), F.when(F.col("_scored"), F.col("_at"))), "last": F.max_by(F.struct(*kept), F.col("_at"))}
    totals = [null_strict_sum(c).alias(f"total_{c}") for c in USAGE if c in rows.columns]
    found = rows.groupBy("request_hash").agg(*[c.alias(n) for n, c in best.items()], F.count("*").alias("attempts"), *totals)
    return found.withColumn("r", F.coalesce("first", "last")).select("request_hash", "r.*", "attempts", *[f"total_{c}" for c in USAGE if c in rows.columns])


def totals(rows: DataFrame) -> DataFrame:
    """One row over all attempts: how many, and each counter's sum, null if any attempt's is unknown or there is none."""
    return rows.agg(F.count("*").alias("attempts"), *[null_strict_sum(c).alias(c) for c in USAGE])
