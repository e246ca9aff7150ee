"""The registered query of each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, license_scan, near_dedup, nearest, secret_scan, sentencepiece_bpe, shard_store, source_mix, url_filter, vector_codes, warc
from .runtime import scratch, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


# The rules of the URL filter.
RULES = [
    url_filter.Rule("block", "net"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archives back.

    Null and empty html are empty payloads, which are responses; equal long payloads
    are revisits of the smallest page_id; a null page_id is never referred to; no
    pages give no rows.
    """
    root = scratch(spark, "warc")
    return warc.read(spark, warc.write(spark, table(spark, sf_dir, "pages"), root), root).drop("archive")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and random spans of every document.

    Null and empty texts have no spans; texts are scanned whole; rows are
    independent, so repeated rows repeat and an empty table gives none.
    """
    test = secret_scan.TokenEfficiency(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return secret_scan.scan(table(spark, sf_dir, "documents"), test)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page.

    A null url, or one without ``://``, has an empty host and path and no rule; a
    null url is allowed; equal urls are judged alike; no pages give no rows.
    """
    return url_filter.judge(spark, table(spark, sf_dir, "pages"), RULES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and fate of every document.

    Null, empty and white texts are one group; ties go to the smallest doc_id, null
    last; of fully equal rows one is kept; no documents give no rows.
    """
    return exact_dedup.deduplicate(spark, table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of what they decode to.

    Null and empty texts have no ids; texts are encoded whole; repeated rows repeat;
    no documents give no rows.
    """
    return sentencepiece_bpe.encode_digests(spark, table(spark, sf_dir, "documents"), PIECE_MODEL, remember=400_000)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document.

    Texts without words are their own component; equal rows share one; null doc_ids
    come after all others; no documents give no rows.
    """
    return near_dedup.deduplicate(spark, table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector.

    Null, zero and non-finite vectors and null ids take no part; ties go to the
    smaller id; equal rows count once; no vectors give no rows.
    """
    return nearest.search(spark, table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document.

    Null texts have size 0 and are taken 0 times; a null source is the last; equal
    rows are taken each for itself; no documents give no rows.
    """
    return source_mix.mix(spark, table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document.

    Null texts and texts without a letter are ``und`` with score 0; null labels
    teach nothing; repeated rows repeat; no documents give no rows.
    """
    return language_id.identify(spark, table(spark, sf_dir, "documents"))


def op10_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from compacted shards.

    All columns and rows are stored as they are, nulls and repeated rows too; no
    documents give no rows.
    """
    return shard_store.compacted(spark, table(spark, sf_dir, "documents"), scratch(spark, "shards"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license blocks of every document.

    Null and empty texts have no words, no places and empty labels; texts are scanned
    whole; repeated rows repeat; no documents give no rows.
    """
    return license_scan.summarised(license_scan.scan(spark, table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, and a digest of the codebooks.

    Null vectors and those with null or non-finite components are left out; repeated
    rows repeat; null labels share a sum; fewer than 16 keys give as many entries; no
    vectors give no rows.
    """
    coded = vector_codes.compress(spark, table(spark, sf_dir, "embeddings"))
    return coded.rows.withColumn("codebooks_sha256", F.lit(coded.sha256))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


WARC = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (SELECT payload_digest, min(page_id) AS first FROM sized GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM sized JOIN firsts USING (payload_digest)
"""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('0:' || doc_id) AS h FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source
), weighed AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][(sid - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS cap FROM per_source
), levels AS (
  SELECT *, cap / weight AS ratio,
    ((SELECT sum(source_size) FROM weighed)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), opened AS (SELECT ratio AS r, sid AS i, level AS l FROM levels WHERE level <= ratio ORDER BY ratio, sid LIMIT 1
), blocked AS (
  SELECT source, sid, source_size, CASE WHEN (ratio, sid) < (r, i) THEN cap ELSE coalesce(l * weight, cap) END AS target,
    CASE WHEN source_size > 0 THEN greatest(1, source_size // greatest(1, least(256, (SELECT sum(source_size) FROM weighed) // (8192 * (SELECT count(*) FROM weighed))))) ELSE 0 END::BIGINT AS blocks
  FROM levels LEFT JOIN opened ON true
), slotted AS (SELECT *, CASE WHEN blocks > 0 THEN target / (source_size / blocks) ELSE 0 END AS slots FROM blocked
), spans AS (
  SELECT sid, blocks, low, coalesce(lead(low) OVER (ORDER BY sid), 1.0) AS high FROM (
    SELECT sid, blocks, coalesce(sum(slots / (SELECT sum(slots) FROM slotted)) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS low FROM slotted WHERE slots > 0)
), points AS (
  SELECT id, (id + 1) * 0.6180339887498949::DOUBLE - floor((id + 1) * 0.6180339887498949::DOUBLE) AS u FROM range((SELECT CAST(round(sum(slots)) AS BIGINT) FROM slotted)) p(id)
), ranked AS (SELECT sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY id) - 1 AS nth FROM points JOIN spans ON u >= low AND u < high
), times AS (SELECT sid, nth % blocks AS block, count(*) AS times FROM ranked WHERE nth < blocks * 3 GROUP BY ALL
), placed AS (
  SELECT doc_id, size, sid, source_size, target, blocks, source_size // nullif(blocks, 0) AS short, source_size % nullif(blocks, 0) AS longer,
    CAST(coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized JOIN slotted ON sized.source IS NOT DISTINCT FROM slotted.source
), ends AS (
  SELECT *, CASE WHEN start < longer * (short + 1) THEN start // (short + 1) ELSE longer + (start - longer * (short + 1)) // short END AS b0,
    CASE WHEN start + size - 1 < longer * (short + 1) THEN (start + size - 1) // (short + 1) ELSE longer + (start + size - 1 - longer * (short + 1)) // short END AS b1
  FROM placed WHERE size > 0
), pieces AS (SELECT *, unnest(range(b0, b1 + 1)) AS block FROM ends
), taken AS (
  SELECT doc_id, sum((least(start + size, (p.block + 1) * short + least(p.block + 1, longer)) - greatest(start, p.block * short + least(p.block, longer))) * coalesce(times, 0)) AS taken
  FROM pieces p LEFT JOIN times t ON t.sid = p.sid AND t.block = p.block GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN taken USING (doc_id)
"""

EXACT_DEDUP = r"""
WITH sized AS (
  SELECT doc_id, coalesce(length(text), 0) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), stays AS (
  SELECT text_sha256, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size
  FROM sized GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM sized JOIN stays USING (text_sha256)
"""


def vector_code_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds written out, each as the nearest entry of every part and the entries' new components."""
    book = """
book{n} AS (
  SELECT p, e, list(c ORDER BY i) AS b FROM (
    SELECT o.p, o.e, i, CASE WHEN m.n IS NULL THEN o.b[i] ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS c
    FROM (SELECT p, e, b, unnest(range(1, len(b) + 1)) AS i FROM book{o}) o LEFT JOIN sums{o} m USING (p, e, i)
  ) GROUP BY p, e
)"""
    near = """
near{n} AS MATERIALIZED (
  SELECT r, p, x, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, p, e, x, list_sum([(u[1] - u[2]) * (u[1] - u[2]) FOR u IN list_zip(x, b)])::BIGINT AS d FROM cut JOIN book{n} USING (p)) GROUP BY r, p, x
), sums{n} AS MATERIALIZED (SELECT p, e, i, count(*) AS n, sum(x[i]) AS s FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM near{n}) GROUP BY p, e, i)"""
    steps = [near.format(n=0)]
    for k in range(1, rounds + 1):
        steps += [book.format(n=k, o=k - 1).replace(f"book{k} AS", f"book{k} AS MATERIALIZED"), near.format(n=k)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
), cut AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM (SELECT r, v, unnest(range({parts})) AS p FROM kept)),
book0 AS (SELECT p, r - 1 AS e, x AS b FROM cut WHERE r <= {entries}),{",".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r) CROSS JOIN books"""


COMPACTION = "SELECT doc_id, lang, source, sha256(text) AS text_sha256, true AS listed FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"op10_compaction": COMPACTION, "op12_vector_codes": vector_code_sql(), "op1_warc": WARC, "op4_exact_dedup": EXACT_DEDUP, "op8_mix": MIX}
