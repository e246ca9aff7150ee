"""The jobs: growing input, reruns, runs cut short, command lines, and their results against the library's."""

import json
import logging
import os
import subprocess
import sys
import time
import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle import storage
from brindle.functions import tokenizer
from brindle.operators import many, packing, ranking
from brindle.streaming import term_index as index
from jobs import catalogue, evidence_packs, term_index
from jobs.command import read_config

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string"


def fresh(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/test-{uuid.uuid4().hex}"


def deliver(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files of later deliveries are newer


def found(spark, out):
    return {(r.key, r.term): r.tf for r in index.postings(spark, out).collect()}


FIRST = [(1, "payRefund total totals", "a", "en"), (2, "renew payment", None, "en"), (3, None, "b", None), (4, "", "b", "fr"), (None, "no key", "b", "fr"), (5, "same", "a", "en"), (5, "same", "a", "en")]
SECOND = [(2, "renewed refunds", None, "en"), (6, "total refund", "c", "en")]


def test_index_takes_only_what_is_new(spark, caplog):
    source, at = fresh(spark), fresh(spark)
    out, checkpoint = f"{at}/index", f"{at}/checkpoint"
    config = read_config(None, term_index.CONFIG)
    deliver(spark, FIRST, source)
    with caplog.at_level(logging.INFO, "brindle"):
        first = term_index.run(spark, config, source, out, checkpoint)
    assert first["texts"] == 6 and first["batches"] == 1 and "6 texts" in caplog.text
    assert {k: v for k, v in found(spark, out).items() if k[0] == 1} == {(1, t): n for t, n in {"payrefund": 1, "pay": 1, "refund": 1, "total": 2, "totals": 1}.items()}
    before = sorted(map(str, index.current(spark, out).collect()))
    assert term_index.run(spark, config, source, out, checkpoint) == {"batches": 0, "texts": 0, "postings": 0}
    assert sorted(map(str, index.current(spark, out).collect())) == before

    deliver(spark, SECOND, source)
    assert term_index.run(spark, config, source, out, checkpoint)["texts"] == 2
    now = {r.key: r for r in index.current(spark, out).collect()}
    assert sorted(now) == [1, 2, 3, 4, 5, 6] and now[2].length == 3 and now[3].digest is None and now[4].source == "b"
    assert ("payment" not in {t for k, t in found(spark, out) if k == 2}) and (2, "refund") in found(spark, out)

    # what a search finds is what BM25 over the current texts finds
    texts = {r[0]: r[1] for r in FIRST + SECOND if r[0]}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    for query in ("refunds total", "same", "nothing known", "the of"):
        plain = [(r.id, r.score) for r in ranking.lexical_search(docs, query, {"body": F.col("text")}, 4).collect()]
        assert [(r.key, r.score) for r in index.search(spark, out, query, 4, term_index.settings(config)).collect()] == plain


def test_index_one_file_a_batch_gives_the_same(spark):
    source, one, two = fresh(spark), fresh(spark), fresh(spark)
    for rows in (FIRST, SECOND, [(1, "back again", "a", "en")]):
        deliver(spark, rows, source)
    config = read_config(None, term_index.CONFIG)
    assert term_index.run(spark, config, source, f"{one}/index", f"{one}/checkpoint")["batches"] == 1
    assert term_index.run(spark, config | {"files_per_batch": 1, "buckets": 3}, source, f"{two}/index", f"{two}/checkpoint")["batches"] == 3
    assert found(spark, f"{one}/index") == found(spark, f"{two}/index")
    columns = ("key", "version", "digest", "source", "lang", "length")
    assert sorted(map(str, index.current(spark, f"{one}/index").select(*columns).collect())) == sorted(map(str, index.current(spark, f"{two}/index").select(*columns).collect()))


def test_index_goes_on_where_a_run_was_cut_short(spark, monkeypatch):
    """A batch fails after its postings are written; the next run writes it anew."""
    source, at = fresh(spark), fresh(spark)
    deliver(spark, FIRST, source)
    config = read_config(None, term_index.CONFIG)
    broken = index.tokenised
    with monkeypatch.context() as m:
        m.setattr(index, "tokenised", lambda batch: broken(batch).withColumn("length", F.raise_error(F.lit("cut short")).cast("long")))
        with pytest.raises(Exception, match="cut short"):
            term_index.run(spark, config, source, f"{at}/index", f"{at}/checkpoint")
    assert term_index.run(spark, config, source, f"{at}/index", f"{at}/checkpoint")["texts"] == 6
    assert index.current(spark, f"{at}/index").count() == 5 and index.postings(spark, f"{at}/index").where("key = 1").count() == 5


def test_index_sends_small_batches_to_its_workers(spark, monkeypatch):
    """However many texts a file has, a worker gets a thousand at once at most; and words that hardly come again aren't remembered."""
    source, at = fresh(spark), fresh(spark)
    spark.range(3500).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("a").alias("source"), F.lit("en").alias("lang")).coalesce(1).write.parquet(source)
    before = {k: spark.conf.get(k) for k in storage.BATCHES}

    def watched(batches):
        for b in batches:
            assert len(b) <= 1000, "too many at once"
            yield b

    with monkeypatch.context() as m:
        whole = index.tokenised
        m.setattr(index, "tokenised", lambda batch: whole(batch.mapInArrow(watched, batch.schema)))
        assert term_index.run(spark, read_config(None, term_index.CONFIG), source, f"{at}/index", f"{at}/checkpoint")["texts"] == 3500
    assert before == {k: spark.conf.get(k) for k in storage.BATCHES}
    assert tokenizer.text_terms("y" * 100_000) == ["y" * 100_000] and "y" * 100_000 not in tokenizer._TERMS


def test_index_of_nothing(spark):
    source, at = fresh(spark), fresh(spark)
    config = read_config(None, term_index.CONFIG)
    deliver(spark, [(1, None, None, None)], source)
    assert term_index.run(spark, config, source, f"{at}/index", f"{at}/checkpoint") == {"batches": 1, "texts": 1, "postings": 0}
    assert index.search(spark, f"{at}/index", "total", 3).collect() == [] and index.postings(spark, f"{at}/index").collect() == []


DOCS = [(1, "renew payment total", "a"), (2, "payment " * 30 + "x" * 900, "a"), (3, "payment of totals", None), (4, None, "b"), (5, "nothing here", "b"), (3, "payment of totals", None), (6, "payment due", "c"), (6, "payment of dues", "c"), (None, "payment", "c")]
TASKS = [("t1", "payment total"), ("t2", "zzz"), ("t3", None), ("t4", "PaymentTotals nothing"), (None, "payment")]


def plain_best(docs, query, limit):
    """BM25 as the formula says it, one document after another."""
    import math
    from collections import Counter

    from brindle.functions.tokenizer import text_terms

    lists = [text_terms(t) for _, t, _ in docs]
    mean = sum(map(len, lists)) / len(lists)
    terms = sorted(set(text_terms(query)))
    out = []
    for (key, _, source), own in zip(docs, lists, strict=True):
        tf, score = Counter(own), 0.0
        for t in terms:
            df = sum(t in x for x in lists)
            if tf[t]:
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(own) / mean))
        if score > 0 and key is not None:
            out.append((key, round(score, 9), source))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:limit]


@pytest.mark.parametrize("block", [1, 3])
def test_best_of_many_plainly(spark, block):
    docs = spark.createDataFrame(DOCS, "doc long, text string, source string").repartition(3)
    queries = spark.createDataFrame(TASKS, "query string, text string")
    got = {}
    for r in sorted(many.best(docs, queries, 4, block, keep=("source",), key="doc").collect(), key=lambda r: r.pos):
        got.setdefault(r["query"], []).append((r.doc, round(r.score, 9), r.source))
    assert got == {k: v for k, t in TASKS if k and (v := plain_best(DOCS, t, 4))}


def test_best_of_many_reads_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def met(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(DOCS, "doc long, text string, source string").repartition(3).withColumn("text", met.asNondeterministic()("text"))
    assert many.best(docs, spark.createDataFrame(TASKS, "query string, text string"), 4, 1, keep=("source",), key="doc").count() == sum(len(plain_best(DOCS, t, 4)) for k, t in TASKS if k and t)
    assert read.value == len(DOCS)


def test_best_of_many_in_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(many, "BLOCKS", 2)
    docs, queries = spark.createDataFrame(DOCS, "doc long, text string, source string"), spark.createDataFrame(TASKS, "query string, text string")
    got = many.best(docs, queries, 4, 1, key="doc").collect()
    assert {(r["query"], r.doc, round(r.score, 9)) for r in got} == {(k, d, x) for k, t in TASKS if k and t for d, x, _ in plain_best(DOCS, t, 4)}


def test_best_of_many_keeps_types_and_says_when_there_is_nothing(spark):
    docs = spark.createDataFrame([(1, "payment due", True), (2, "payment", None)], "id int, text string, flag boolean")
    queries = spark.createDataFrame([(7, "payment"), (8, "the of"), (7, "due")], "query smallint, text string")
    got = many.best(docs, queries, 5, keep=("flag",))
    assert got.dtypes == [("query", "smallint"), ("pos", "int"), ("id", "int"), ("score", "double"), ("flag", "boolean")]
    assert [(r["query"], r.pos, r.id, r.flag) for r in got.orderBy("pos").collect()] == [(7, 1, 1, True), (7, 2, 2, None)]
    for d, q in ((docs.limit(0), queries), (docs, queries.limit(0)), (docs, queries.where("query = 8"))):
        assert many.best(d, q, 5).collect() == []
    with pytest.raises(ValueError):
        many.best(docs, queries, 0)


def test_pack_each_is_pack(spark):
    import random

    rng = random.Random(3)
    rows = [(g, p, rng.choice([10, 300, 900, 2000, 5000]), f"{g}{p}") for g in "abc" for p in range(1, 15)]
    each = packing.pack_each(spark.createDataFrame(rows, "g string, pos long, bytes long, id string"), "g", 34, 1000)
    got = {(r.g, r.id): (r.kept, r.used) for r in each.collect()}
    for g in "abc":
        own = spark.createDataFrame([(p, i, b, False) for k, p, b, i in rows if k == g], "pos long, id string, bytes long, seed boolean")
        assert {(g, r.id): (r.kept, r.used) for r in packing.pack(own, 34, 1000).collect()} == {k: v for k, v in got.items() if k[0] == g}


def test_packs(spark, caplog):
    at = fresh(spark)
    spark.createDataFrame(DOCS, "doc_id long, text string, source string").write.parquet(f"{at}/docs")
    spark.createDataFrame(TASKS, "item_id string, text string").write.parquet(f"{at}/tasks")
    config = read_config(None, evidence_packs.CONFIG) | {"budget": 100}
    with caplog.at_level(logging.INFO, "jobs"):
        counts = evidence_packs.run(spark, config, f"{at}/tasks", f"{at}/docs", f"{at}/out")
    assert counts["packets"] == 4 and "wrote 4 packets" in caplog.text
    table = lambda name: evidence_packs.read(spark, f"{at}/out", name, query="string")
    read = lambda name: sorted(map(str, table(name).collect()))
    before = read("hits"), read("packets")
    packets = {r["query"]: r for r in table("packets").collect()}
    assert packets["t2"].status == packets["t3"].status == "no_matches" and packets["t2"].text == evidence_packs.HEADER
    assert packets["t1"].status == "partial" and packets["t1"].tokens <= 100 and "x" * 900 not in packets["t1"].text
    for q, packet in packets.items():
        kept = table("hits").where((F.col("query") == q) & F.col("kept")).orderBy("pos").collect()
        assert packet.n_kept == len(kept) == packet.text.count("\n--- ") and (not kept or kept[-1].used == len(packet.text.encode()))
    assert evidence_packs.run(spark, config, f"{at}/tasks", f"{at}/docs", f"{at}/out") == counts
    assert (read("hits"), read("packets")) == before
    # a smaller table leaves nothing of the larger one behind
    spark.createDataFrame(TASKS[1:2], "item_id string, text string").write.parquet(f"{at}/few")
    evidence_packs.run(spark, config, f"{at}/few", f"{at}/docs", f"{at}/out")
    assert len(read("packets")) == 1 and read("hits") == []


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_jobs_against_sql(spark, name):
    from test_oracles import rows

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(catalogue.ORACLES[name]).df())


def test_command_line(tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps(read_config(None, term_index.CONFIG) | {"buckets": 2}))
    args = ["--source", f"{SF}/documents.parquet", "--output", str(tmp_path / "index"), "--checkpoint", str(tmp_path / "checkpoint"), "--config", str(config)]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"}
    for told in ("200 new texts in 1 batches", "0 new texts in 0 batches"):
        done = subprocess.run([sys.executable, "-m", "jobs.term_index", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and told in done.stderr, done.stderr[-2000:]
    assert {p.name for p in (tmp_path / "index/postings/batch=0").glob("bucket=*")} == {"bucket=0", "bucket=1"}
