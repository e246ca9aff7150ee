"""An index of texts that grows with the files that arrive.

New files are found by a file stream; each batch of them is tokenised once and
written as two tables, in a folder of its own:

* ``postings`` (key, version, term, tf, length), partitioned by batch and by a
  bucket of the term, so that a search reads the buckets of its terms only;
* ``texts`` (key, version, length, digest, kept columns), partitioned by batch.

A batch that is tried again overwrites its own folders, and ``texts`` is written
last: what it doesn't list doesn't count.  A key that comes again replaces what
it was before (see ``current``); its older postings stay and are left out when
read.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokenizer import lists, text_counts
from ..operators import ranking
from ..storage import small_batches, workers_import_this

log = logging.getLogger(__name__)

#: Texts whose terms a task holds at once.
SLICE = 100


@dataclass(frozen=True)
class Settings:
    key: str = "doc_id"
    text: str = "text"
    #: Columns kept beside each text.
    keep: tuple[str, ...] = ()
    #: Buckets of terms, and files of a bucket that a batch writes at most.
    buckets: int = 16
    files_per_bucket: int = 4
    #: Files that one batch takes.
    files_per_batch: int = 64


def bucket_of(term: Column, buckets: int) -> Column:
    """A number below ``buckets`` (65,536 at most) from the term's MD5."""
    return (F.conv(F.substr(F.md5(term), F.lit(1), F.lit(4)), 16, 10).cast("int") % buckets).cast("int")


def ingest(spark: SparkSession, source: str, output: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Index the files of ``source`` that no earlier run with this checkpoint has taken; waits until all are.

    ``source`` is a folder of Parquet files, a pattern, or one file.
    Returns the batches, texts and postings of this run.  Null texts have no
    terms; rows with null keys are left out; repeated rows are versions of one
    text.  A folder without files yet gives nothing.
    """
    workers_import_this(spark)
    totals: Counter[str] = Counter(batches=0, texts=0, postings=0)
    try:
        now = spark.read.parquet(source)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        log.info("no files in %s", source)
        return dict(totals)

    def add(batch: DataFrame, number: int) -> None:
        at = {name: f"{output}/{name}/batch={number}" for name in ("postings", "texts")}
        rows = tokenised(batch).persist(StorageLevel.DISK_ONLY)
        try:
            found = rows.select("key", "version", "length", F.inline(F.arrays_zip("term", "tf"))).select("key", "version", "term", "tf", "length", bucket_of(F.col("term"), settings.buckets).alias("bucket"))
            spread = found.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(settings.files_per_bucket))).sortWithinPartitions("bucket", "term", "key")
            spread.write.mode("overwrite").partitionBy("bucket").parquet(at["postings"])
            rows.drop("term", "tf").write.mode("overwrite").parquet(at["texts"])
            wrote = {"texts": rows.count(), "postings": rows.agg(F.coalesce(F.sum(F.size("term")), F.lit(0))).first()[0]}
        finally:
            rows.unpersist()
        log.info("batch %d of %s: %d texts and %d postings written to %s", number, source, wrote["texts"], wrote["postings"], output)
        totals.update(wrote, batches=1)

    own = source.rstrip("/").rsplit("/", 1)[-1]
    # a stream takes folders and patterns: a single file is given as a pattern that only it matches
    files = f"{source.rstrip('/')[:-1]}[{own[-1]}]" if any(unquote(f).endswith(f"/{own}") for f in now.inputFiles()) else source
    stream = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", settings.files_per_batch).parquet(files)
    meta = F.col("_metadata")
    place = F.concat_ws("#", meta["file_path"], F.lpad(meta["row_index"].cast("string"), 19, "0"))
    slim = stream.where(F.col(settings.key).isNotNull()).select(
        F.col(settings.key).alias("key"), F.struct(F.unix_micros(meta["file_modification_time"]).alias("arrived"), place.alias("place")).alias("version"),
        F.sha2(F.col(settings.text), 256).alias("digest"), *[F.col(c) for c in settings.keep], F.col(settings.text).alias("text"),
    )
    with small_batches(spark):  # a stream has the settings of its start
        query = slim.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d new texts in %d batches, %d postings", source, totals["texts"], totals["batches"], totals["postings"])
    return dict(totals)


def tokenised(batch: DataFrame) -> DataFrame:
    """The rows with, instead of ``text``, its number of terms, its different terms in order, and how often each stands in it."""
    kinds = [(f.name, f.dataType.simpleString()) for f in batch.drop("text").schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, len(part), SLICE):
                piece = part.slice(at, SLICE)
                found = [dict(sorted(text_counts(t.as_py()).items())) for t in piece.column("text")]
                added = [pa.array([sum(f.values()) for f in found], pa.int64()), lists(found, pa.string()), lists((f.values() for f in found), pa.int32())]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n, _ in kinds), *added], [*(n for n, _ in kinds), "length", "term", "tf"])

    schema = ", ".join(f"`{n}` {kind}" for n, kind in [*kinds, ("length", "bigint"), ("term", "array<string>"), ("tf", "array<int>")])
    return batch.mapInArrow(count, schema)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The newest version of each key: key, version, digest, kept columns, length, batch.

    The newest is the one whose file was written last, then the greatest path
    and row.  Texts themselves aren't in the table, so its rows are narrow.
    """
    texts = spark.read.parquet(f"{output}/texts")
    newest = Window.partitionBy("key").orderBy(F.desc("version"))
    return texts.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def postings(spark: SparkSession, output: str, terms: list[str] | None = None, buckets: int = Settings.buckets) -> DataFrame:
    """Postings of current versions (key, term, tf, length, bucket), all or those of ``terms``, whose buckets alone are read."""
    texts = spark.read.parquet(f"{output}/texts").schema
    kinds = {n: texts[n].dataType.simpleString() for n in ("key", "version")}
    # the columns are named, as texts without terms leave no file to infer them from
    rows = spark.read.schema(f"key {kinds['key']}, version {kinds['version']}, term string, tf int, length bigint, batch int, bucket int").parquet(f"{output}/postings")
    if terms is not None:
        numbers = spark.range(1).select(F.array(*[bucket_of(F.lit(t), buckets) for t in terms]).alias("b")).first()["b"]
        rows = rows.where(F.col("bucket").isin(sorted(set(numbers))) & F.col("term").isin(terms))
    return rows.join(current(spark, output).select("key", "version"), ["key", "version"], "left_semi").select("key", "term", "tf", "length", "bucket")


def search(spark: SparkSession, output: str, query: str, limit: int, settings: Settings = Settings()) -> DataFrame:
    """The best texts for a query (key, score) from the index alone, scored as ``ranking.lexical`` scores them.

    Corpus size and mean length come from ``texts``, frequencies from the
    buckets of the query's terms; no text is read.
    """
    terms = ranking.query_terms(spark, query)
    if not terms:
        return current(spark, output).limit(0).select("key", F.lit(0.0).alias("score"))
    wide = postings(spark, output, terms, settings.buckets).groupBy("key").agg(
        F.max("length").alias("body_len"), *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"body_tf{i}") for i, t in enumerate(terms)]
    )
    frequencies = wide.agg(*[F.count_if(F.col(f"body_tf{i}") > 0).alias(f"body_df{i}") for i in range(len(terms))])
    sizes = current(spark, output).agg(F.count("*").alias("_n"), F.avg("length").alias("body_avg"))
    scored = wide.join(F.broadcast(frequencies), F.lit(True)).join(F.broadcast(sizes), F.lit(True))  # a row each
    return scored.select("key", ranking.bm25("body", len(terms)).alias("score")).where("score > 0").orderBy(F.desc("score"), "key").limit(limit)
