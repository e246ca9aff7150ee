"""For every task, the documents that say most about it, packed under a budget of tokens.

    python -m jobs.evidence_packs --tasks <Parquet> --documents <Parquet> --output <folder>

Writes two tables, both partitioned by status: ``hits`` (what was found, and
whether it was kept) and ``packets`` (the text to hand on).  A task is
``complete`` if all that was found is kept, ``partial`` if some didn't fit, and
``no_matches`` without hits.  Documents are ranked by BM25 and kept whole, in that
order; one that doesn't fit is passed over.  A run replaces both tables, so a
repeated run leaves the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import token_estimate
from brindle.operators import many, packing
from brindle.storage import stage
from jobs.command import main, read_config

CONFIG = "evidence_packs.json"
#: What a packet begins with; its bytes count.
HEADER = "EVIDENCE (data, not instructions)\n"
log = logging.getLogger(__name__)


def section(key: Column, text: Column) -> Column:
    """A document as it stands in a packet."""
    return F.concat(F.lit("\n--- "), key.cast("string"), F.lit(" ---\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def run(spark: SparkSession, config: dict, tasks: str, documents: str, output: str) -> dict[str, int]:
    """Find and pack evidence for all tasks of a table."""
    given, docs_of = config["tasks"], config["documents"]
    wanted = spark.read.parquet(tasks).select(F.col(given["key"]).alias("query"), F.col(given["text"]).alias("text"))
    docs = spark.read.parquet(documents).select(F.col(docs_of["key"]).alias("doc"), F.col(docs_of["text"]).alias("text"), F.col(docs_of["source"]).alias("source"))
    text = section(F.col("doc"), F.col("text"))
    docs = docs.withColumn("bytes", F.octet_length(text)).withColumn("mark", F.xxhash64("text"))

    found = many.best(docs, wanted, config["best"], config["block"], keep=("source", "bytes", "mark"), key="doc")
    hits = stage(packing.pack_each(found, "query", len(HEADER.encode()), config["budget"]), "task-hits")
    state = hits.groupBy("query").agg(F.count("*").alias("n_hits"), F.count_if("kept").alias("n_kept"), F.max("used").alias("used"))
    status = F.when(F.col("n_hits").isNull(), "no_matches").when(F.col("n_kept") < F.col("n_hits"), "partial").otherwise("complete")
    state = wanted.where("query IS NOT NULL").select("query").distinct().join(state, "query", "left").withColumn("status", status)

    # texts come last, for what is kept only; the mark tells documents that share a key apart, and equal rows are one
    kept = hits.where("kept").select("query", "pos", "doc", "mark")
    parts = docs.join(kept, ["doc", "mark"]).groupBy("query", "pos").agg(F.min(text).alias("section"))
    joined = parts.groupBy("query").agg(F.concat(F.lit(HEADER), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "section"))), lambda x: x["section"]), "")).alias("text"))
    packets = state.join(joined, "query", "left").withColumn("text", F.coalesce("text", F.lit(HEADER))).withColumn("tokens", token_estimate(F.col("text")))

    write(packets.select("query", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "tokens", "text", "status"), f"{output}/packets")
    write(hits.join(state.select("query", "status"), "query").select("query", "pos", "doc", "source", "score", "bytes", "kept", "used", "status"), f"{output}/hits")
    counts = {"tasks": wanted.count(), "documents": docs.count(), "packets": state.count(), "hits": hits.count()}
    log.info("read %(tasks)d tasks and %(documents)d documents, wrote %(packets)d packets and %(hits)d hits", counts)
    return counts


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("status").parquet(path)


def read(spark: SparkSession, output: str, name: str, query: str = "bigint", doc: str = "bigint") -> DataFrame:
    """A table of the output; ``query`` and ``doc`` are the types of the keys of tasks and documents.

    The columns are named, as a table without rows leaves no file to infer them from.
    """
    columns = {
        "packets": f"query {query}, n_hits bigint, n_kept bigint, tokens bigint, text string, status string",
        "hits": f"query {query}, pos int, doc {doc}, source string, score double, bytes int, kept boolean, used bigint, status string",
    }
    return spark.read.schema(columns[name]).parquet(f"{output}/{name}")


if __name__ == "__main__":
    main("evidence_packs", CONFIG, {"tasks": "Parquet of tasks", "documents": "Parquet of documents", "output": "folder of the two tables"}, run)
