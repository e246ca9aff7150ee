"""The jobs as queries over whole tables, each with its SQL.

A query runs its job twice into one new folder under the shared one, waits for
its stream, leaves the files and returns what they hold after the second run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.queries import DOCS, token_ctes
from brindle.storage import shared_dir
from brindle.streaming import term_index as index
from jobs import evidence_packs, term_index
from jobs.command import read_config


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each term of each document, and one, without a bucket (-1), for each document without terms."""
    config, at = read_config(None, term_index.CONFIG), folder(spark, "job1-term-index")
    for _ in range(2):
        term_index.run(spark, config, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    texts = index.current(spark, f"{at}/index").select("key", "length", "digest", "source", "lang")
    found = index.postings(spark, f"{at}/index").select("key", "term", "tf", "bucket")
    return texts.join(found, "key", "left").withColumns({"tf": F.coalesce("tf", F.lit(0)), "bucket": F.coalesce("bucket", F.lit(-1))}).withColumnRenamed("key", "doc_id")


def job2_evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document found for a task, with the task's packet, and one for each task without any."""
    config, at = read_config(None, evidence_packs.CONFIG), folder(spark, "job2-evidence-packs")
    for _ in range(2):
        evidence_packs.run(spark, config, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", at)
    packets = evidence_packs.read(spark, at, "packets").select("query", "status", "n_hits", "n_kept", "tokens", F.sha2("text", 256).alias("packet_sha256"))
    hits = evidence_packs.read(spark, at, "hits").select("query", "pos", "doc", "source", F.round("score", 6).alias("score"), "bytes", "kept", "used")
    return packets.join(hits, "query", "left").withColumnsRenamed({"query": "item_id", "doc": "doc_id"})


QUERIES = {f.__name__: f for f in (job1_term_index, job2_evidence_packs)}

_INDEX = f"""WITH {token_ctes('k', DOCS)}, f AS (
  SELECT id, term, count(*) AS tf FROM k GROUP BY id, term
), n AS (SELECT id, sum(tf) AS length FROM f GROUP BY id)
SELECT doc_id, CAST(coalesce(length, 0) AS BIGINT) AS length, sha256(text) AS digest, source, lang, term, CAST(coalesce(tf, 0) AS INTEGER) AS tf,
       CAST(coalesce(('0x' || substr(md5(term), 1, 4))::INTEGER % 16, -1) AS INTEGER) AS bucket
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN f ON f.id = doc_id"""

_HEADER = f"'{evidence_packs.HEADER.strip()}' || chr(10)"
_PACKS = rf"""WITH RECURSIVE {token_ctes('q', 'SELECT item_id AS id, text AS x FROM benchmark')},
wanted AS MATERIALIZED (SELECT DISTINCT id AS item_id, term FROM q),
{token_ctes('k', DOCS)},
n AS MATERIALIZED (SELECT doc_id AS id, count(term) AS len FROM documents LEFT JOIN k ON k.id = doc_id GROUP BY doc_id),
s AS (SELECT count(*) AS n, avg(len) AS mean FROM n),
f AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM k WHERE term IN (SELECT term FROM wanted) GROUP BY id, term),
d AS MATERIALIZED (SELECT term, count(*) AS df FROM f GROUP BY term),
scored AS MATERIALIZED (
  SELECT item_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) ORDER BY term) AS score
  FROM wanted JOIN f USING (term) JOIN d USING (term) JOIN n USING (id) CROSS JOIN s GROUP BY item_id, id
), hits AS MATERIALIZED (
  SELECT item_id, pos, doc_id, source, score, section, strlen(section) AS bytes FROM (
    SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS pos FROM scored
  ) JOIN (SELECT doc_id, source, chr(10) || '--- ' || doc_id || ' ---' || chr(10) || coalesce(text, '') || chr(10) AS section FROM documents) ON doc_id = id WHERE pos <= 20
), packed AS (
  SELECT item_id, CAST(0 AS BIGINT) AS pos, false AS kept, CAST(strlen({_HEADER}) AS BIGINT) AS used FROM (SELECT DISTINCT item_id FROM hits)
  UNION ALL
  SELECT item_id, h.pos, ceil((used + bytes) / 3.0) <= 4000, CASE WHEN ceil((used + bytes) / 3.0) <= 4000 THEN used + bytes ELSE used END FROM packed p JOIN hits h USING (item_id) WHERE h.pos = p.pos + 1
), packets AS (
  SELECT item_id, count(*) AS n_hits, count(*) FILTER (kept) AS n_kept, {_HEADER} || coalesce(string_agg(section, '' ORDER BY pos) FILTER (kept), '') AS text
  FROM hits JOIN packed USING (item_id, pos) GROUP BY item_id
)
SELECT b.item_id, CASE WHEN p.n_hits IS NULL THEN 'no_matches' WHEN n_kept < p.n_hits THEN 'partial' ELSE 'complete' END AS status, coalesce(n_hits, 0) AS n_hits, coalesce(n_kept, 0) AS n_kept,
       CAST(ceil(strlen(coalesce(p.text, {_HEADER})) / 3.0) AS BIGINT) AS tokens, sha256(coalesce(p.text, {_HEADER})) AS packet_sha256,
       pos, doc_id, source, round(score, 6) AS score, bytes, kept, used
FROM (SELECT DISTINCT item_id FROM benchmark WHERE item_id IS NOT NULL) b LEFT JOIN packets p USING (item_id) LEFT JOIN (SELECT * FROM hits JOIN packed USING (item_id, pos)) h USING (item_id)"""

ORACLES = {"job1_term_index": _INDEX, "job2_evidence_packs": _PACKS}
