"""Exact deduplication with keyed streaming state.

Rows arrive as a stream of (digest, order, locator).  A streaming aggregation
without watermark keeps one state row per digest for ever, on disk: the row
that stays, where its content lies, and the size of its group.  What a batch
brings is combined per task before it reaches the state, so a digest that holds
a third of all rows costs each task one row.  The final state is read with
Spark's state reader.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import SPACES, located, materialize, of_row, scratch, settings_of, text_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Settings:
    #: Files of arrivals that one batch takes, at most.
    files_per_batch: int = 2000
    #: Memory in MB that the state stores of one executor share.
    state_memory_mb: int = 128
    #: Up to so many digests of groups are sent to every task; beyond, they are joined by a shuffle.
    broadcast_digests: int = 1_000_000


def normalised(text: str | Column = "text") -> Column:
    """The text without white space (U+0009 to U+000D and the space); a null text counts as empty."""
    out = text_or_empty(text)
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def arrivals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What the stream carries of each row (key, text, _file, _row).

    ``rank`` orders the rows of a group: most code points first, then the
    smallest key, null keys last, then the place.
    """
    rank = F.struct((-F.length(text_or_empty(text))).alias("less"), F.col(key).isNull().alias("nameless"), F.col(key).alias("key"), F.col("_file").alias("file"), F.col("_row").alias("row"))
    return docs.select(digest_of(F.col(text)).alias("digest"), rank.alias("rank"))


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful step, over a stream (or a table) of ``arrivals``: a row per digest."""
    return stream.groupBy("digest").agg(F.min("rank").alias("first"), F.count("*").alias("size"))


def run_stream(spark: SparkSession, arrived: str, schema, checkpoint: str, settings: Settings = Settings()) -> DataFrame:
    """Take the files in folder ``arrived`` that ``checkpoint`` hasn't seen; return the whole state.

    Columns: digest, first (the rank of the row that stays), size.  A restart
    after a failure, or a later call with more files, goes on from the
    checkpoint.
    """
    ours = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(settings.state_memory_mb),
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        # a store is closed when its task ends, so an executor holds as many as it has cores, not one per partition
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
        "spark.sql.streaming.metricsEnabled": "false",
    }
    with settings_of(spark, **{k.replace(".", "__"): v for k, v in ours.items()}):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings.files_per_batch).parquet(arrived)
        query = keyed_state(stream).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("first"), F.col(f"value.`{value[1]}`").alias("size"))


def groups(spark: SparkSession, at: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``located`` documents: its rank, the rank of the row that stays, group size and digest.

    On hits, the full bytes are compared: the texts of all groups of two or
    more are grouped by themselves, and two texts under one digest stop the job
    with an error (no such pair is known for SHA-256).
    """
    came = scratch(spark, "arrivals")
    at = at.select(of_row(key).alias("key"), of_row(text).alias("text"), "_file", "_row")
    arrived = arrivals(at, "key", "text")
    arrived.write.option("compression", "zstd").parquet(came)
    table = spark.read.schema(arrived.schema).parquet(came)
    state = materialize(spark, run_stream(spark, came, arrived.schema, scratch(spark, "dedup-state"), settings), "dedup-groups")
    met = state.where(F.col("size") > 1).select("digest")
    if met.count() <= settings.broadcast_digests:
        met = F.broadcast(met)
    texts = at.select(digest_of(F.col("text")).alias("digest"), normalised("text").alias("text")).join(met, "digest", "left_semi")
    # equal texts meet in their task first, so a large group is one row per task
    distinct = texts.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts"))
    checked = distinct.select("digest", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts have one digest"))).otherwise(F.lit(True)).cast("boolean").alias("bytes_equal"))
    known = materialize(spark, state.join(checked, "digest", "left").where(F.coalesce("bytes_equal", F.lit(True))).drop("bytes_equal"), "dedup-known")
    # a join of two plain tables: where one digest has very many rows, Spark deals that partition to several tasks
    return table.join(known, "digest")


def deduplicate(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without their white space; of equal ones the
    longest stays, then the smallest key.  Empty, null and all-white texts are
    equal to each other.  Rows with the same key and text are told apart by
    their place: one of them is kept.  An empty table gives an empty one.
    """
    found = groups(spark, located(spark, docs), settings, key, text)
    return found.select(
        F.col("rank.key").alias(key), F.col("first.key").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("rank") == F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns under their own names.

    Which rows stay, and what nulls, empty texts, repeated rows and an empty
    table give, is as ``deduplicate`` says.
    """
    at = located(spark, docs)
    kept = groups(spark, at, settings, key, text).where(F.col("rank") == F.col("first")).select(F.col("rank.file").alias("_file"), F.col("rank.row").alias("_row"))
    return at.join(kept, ["_file", "_row"], "left_semi").select("r.*")
