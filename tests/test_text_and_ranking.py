import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle import queries
from brindle.functions import tokenizer
from brindle.functions.text import STOPWORDS, token_estimate, tokens
from brindle.functions.tokenizer import corpus_tokens, distinct_tokens, text_terms
from brindle.operators import packing, ranking

WORDS = ["renewPaymentTotal", "HTTPServer2", "retries", "processing", "snake_case_name", "x", "the", "class", "bus", "4", "__init__", "parseURL", "is", "glass", "ABC", "aB3c"]


def slow_tokens(text):
    out = []
    for word in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
        parts = {word.lower()}
        for piece in word.split("_"):
            parts |= {p.lower() for p in re.findall(r"[A-Z]+(?=[A-Z][a-z]|[0-9]|$)|[A-Z]?[a-z]+|[0-9]+", piece)}
        found = set(parts)
        for p in parts:
            if len(p) > 5 and p[-3:] == "ing":
                found.add(p[:-3])
            if len(p) > 4 and p[-3:] == "ies":
                found.add(p[:-3] + "y")
            elif len(p) > 3 and p[-1] == "s" and p[-2:] not in ("ss", "us", "is"):
                found.add(p[:-1])
        out += sorted(t for t in found if t and t not in STOPWORDS and not t.isdigit())
    return out


def test_tokens(spark):
    texts = [" ".join(WORDS), "", "é ñandú_Größe", "a-b.c(d)"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("k"), corpus_tokens(F.col("t")).alias("c"), distinct_tokens(F.col("t")).alias("d")).collect()
    assert all(r.k == slow_tokens(r.t) == r.c and sorted(r.d) == sorted(set(r.k)) for r in rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcsiygnABC_019 .", max_size=30), min_size=1, max_size=30))
def test_tokens_of_any_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("k")).collect()
    assert all(r.k == slow_tokens(r.t) == text_terms(r.t) for r in rows)


def slow_bm25(docs, terms):
    lists = {k: slow_tokens(t) for k, t in docs.items()}
    mean = sum(map(len, lists.values())) / len(lists)
    out = dict.fromkeys(docs, 0.0)
    for term in sorted(terms):
        df = sum(term in x for x in lists.values())
        for k, x in lists.items():
            if tf := x.count(term):
                out[k] += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    return out


def test_bm25_and_ties(spark):
    docs = {"a": "refund total refund", "b": "total", "c": "refund total refund", "d": "", "e": "other words"}
    frame = spark.createDataFrame(list(docs.items()), "id string, body string").repartition(3)
    rows = ranking.lexical(frame, "refund totals", {"body": F.col("body")}).collect()
    want = slow_bm25(docs, set(slow_tokens("refund totals")))
    got = {r.id: r.lexical for r in rows}
    assert set(got) == {k for k, v in want.items() if v}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert got["a"] == got["c"]


def test_exact_names_tie_and_lead(spark):
    frame = spark.createDataFrame([("p1", "pay", "pay pay pay"), ("p2", "pay", ""), ("p3", "other", "pay")], "id string, name string, body string")
    rows = ranking.lexical_search(frame, "pay", {"name": F.col("name"), "body": F.col("body")}, 10, exact=F.col("name") == "pay").collect()
    assert [(r.id, r.score) for r in rows[:2]] == [("p1", 100.0), ("p2", 100.0)]
    with pytest.raises(ValueError):
        ranking.top(frame, True)


@pytest.mark.parametrize("name", ["hybrid_search_documents", "seed_selection", "mean_reciprocal_rank", "retrieval_quality"])
def test_small_batches_go_to_workers(spark, monkeypatch, name):
    """A worker gets a thousand texts at once at most, though one task reads ten thousand."""

    def watched(texts):
        assert len(texts) <= 1000, "too many at once"
        return texts

    whole = ranking.term_frequencies
    monkeypatch.setattr(ranking, "term_frequencies", lambda text, terms: whole(F.arrow_udf(watched, "string")(text), terms))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.1").count() > 0


def test_small_batches_go_to_workers_that_list_terms(spark, monkeypatch):
    def watched(texts):
        assert len(texts) <= 1000, "too many at once"
        return texts

    whole = queries.distinct_tokens
    monkeypatch.setattr(queries, "distinct_tokens", lambda text: whole(F.arrow_udf(watched, "string")(text)))
    assert queries.doc_frequency(spark, "/root/testdata/sf0.1").count() > 0


@pytest.mark.parametrize("name", ["hybrid_search_documents", "mean_reciprocal_rank", "retrieval_quality"])
def test_texts_are_counted_once(spark, monkeypatch, name):
    """One pass of the texts through Python workers, for documents and for notes about them."""
    calls, whole = [], ranking.term_frequencies
    monkeypatch.setattr(ranking, "term_frequencies", lambda text, terms: calls.append(terms) or whole(text, terms))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


@pytest.mark.parametrize("found", [True, False])
def test_chosen_seeds_need_no_python_workers(spark, monkeypatch, found):
    """The few seeds are rows of the driver's; as a Python RDD they would start workers beside those that read the texts."""
    if not found:
        monkeypatch.setattr(queries, "doc_scores", lambda spark, sf_dir: ranking.lexical(spark.createDataFrame([], "id long, body string"), "pay", {"body": F.col("body")}))
    frame = queries.seed_selection(spark, "/root/testdata/sf0.001")
    assert frame.dtypes == [("doc_id", "bigint"), ("new_terms", "string")] and (frame.count() > 0) == found
    assert "ExistingRDD" not in frame._jdf.queryExecution().toString() and "PythonRDD" not in frame._jdf.queryExecution().toRdd().toDebugString()


def test_wanted_terms_are_counted_though_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokenizer, "REMEMBERED", 3)
    monkeypatch.setattr(tokenizer, "LONGEST", 9)
    rng, wanted = random.Random(5), tokenizer.Wanted(["pay", "total", "server"])
    for _ in range(300):
        text = " ".join(rng.choices([*WORDS, "pay", "Totals", "a_long_word_to_pay"], k=rng.randrange(8)))
        terms = text_terms(text)
        assert wanted.count(text) == (len(terms), {i: terms.count(t) for i, t in enumerate(("pay", "total", "server")) if t in terms})
    assert wanted.count(None) == (0, {}) and len(wanted.places) <= 8 and not any(len(w) > 9 for w in {*wanted, *wanted.places})


def test_no_terms_no_rows(spark):
    frame = spark.createDataFrame([("a", "x")], "id string, body string")
    assert ranking.lexical(frame, "the of", {"body": F.col("body")}).count() == 0


def match(name, score, terms, exact=False):
    return {"id": name, "score": score, "terms": set(terms), "exact": exact}


def test_seeds():
    assert ranking.choose_seeds([])["selected"] == []
    four = [match(x, 1.0, "a") for x in "abcd"]
    assert ranking.choose_seeds(four)["ambiguous"]
    assert [s["id"] for s in ranking.choose_seeds(four[:3])["selected"]] == ["a", "b", "c"]
    rows = [match("a", 3.0, ["x"]), match("b", 2.0, ["x"]), match("c", 1.0, ["x", "y"]), match("d", 0.5, ["z"])]
    assert [s["id"] for s in ranking.choose_seeds(rows)["selected"]] == ["a", "c", "d"]
    assert [s["id"] for s in ranking.choose_seeds(rows, {("a", "d")})["selected"]] == ["a", "d", "c"]
    assert [s["id"] for s in ranking.choose_seeds([match("a", 3.0, ["x"], True), *rows[1:]])["selected"]] == ["a"]


def test_packing_skips_and_frees_the_reserve(spark):
    rows = spark.createDataFrame([(0, "x", 30, False), (1, "y", 90, False), (2, "z", 20, False)], "pos long, id string, bytes long, seed boolean")
    assert [r.kept for r in packing.pack(rows, 0, 20).orderBy("pos").collect()] == [True, False, True]
    seed = rows.withColumn("seed", F.lit(True))
    assert [r.kept for r in packing.pack(rows, 0, 20, 15).orderBy("pos").collect()] == [False, False, False]
    assert [r.kept for r in packing.pack(seed, 0, 20, 15).orderBy("pos").collect()] == [True, False, True]
    assert packing.pack(rows.limit(0), 0, 20).count() == 0


def test_packing_goes_on_to_the_end(spark):
    """More sections than were ever taken at once; against a plain fold."""
    rng = random.Random(8)
    sizes = [rng.choice([1, 5, 40, 300, 5000]) + 7 * (i < 6000) for i in range(6000)] + [9000] * 100_000 + [2, 1, 1]
    for reserve in (0, 1500):
        used, left, want = 10, reserve, {}
        for i, n in enumerate(sizes):
            cost = -(-(used + n) // 3)
            if i % 900 == 899 and 4000 - left < cost <= 4000:
                left = 0
            if cost <= 4000 - left:
                used += n
                want[i] = used
        rows = spark.createDataFrame(list(enumerate(sizes)), "pos long, bytes long").select("pos", F.col("pos").cast("string").alias("id"), "bytes", (F.col("pos") % 900 == 899).alias("seed"))
        got = packing.pack(rows, 10, 4000, reserve)
        assert {r.pos: r.used for r in got.where("kept").collect()} == want
        assert got.count() == len(sizes) and got.where("pos = 106000").first().used == max(v for i, v in want.items() if i <= 106_000)
    notes = packing.reserved(rows.select("pos", "id", F.col("bytes").alias("cost")), 6000)
    total, want = 0, []
    for i, n in enumerate(sizes):
        if total + n <= 6000:
            total += n
            want.append(i)
    assert sorted(r.pos for r in notes.where("reserved").collect()) == want



def test_token_estimate(spark):
    assert spark.range(1).select(token_estimate(F.lit("héllo")).alias("n")).first().n == 2
