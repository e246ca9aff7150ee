"""Reuse of parsed units by digest, parser and checksum, and what a generation reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(units: DataFrame, sources: DataFrame, parser: str) -> DataFrame:
    """Stored units (path, digest, parser, payload, checksum) that hold for the sources (path, hash)."""
    live = sources.select("path", F.col("hash").alias("digest"))
    intact = (F.col("parser") == parser) & (F.sha2("payload", 256) == F.col("checksum"))
    return units.where(intact).join(live, ["path", "digest"], "left_semi")


def misses(sources: DataFrame, usable_units: DataFrame) -> DataFrame:
    return sources.join(usable_units.select("path"), "path", "left_anti")


def counters(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for two generations (path, hash): captured, reused, parsed and removed files."""
    a, b = stored.select("path", F.col("hash").alias("was")), sources.select("path", F.col("hash").alias("now"), F.lit(True).alias("here"))
    here, same = F.coalesce("here", F.lit(False)), F.coalesce(F.col("was") == F.col("now"), F.lit(False))
    return a.join(b, "path", "full").agg(F.count_if(here).alias("captured"), F.count_if(here & same).alias("reused"), F.count_if(here & ~same).alias("parsed"), F.count_if(~here).alias("removed"))
