"""Answers of runners, judged against the requests that they say they answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import untrusted as U

# What a runner may report instead of an answer.
REPORTED = ("rate_limited", "provider_error", "invalid_response", "model_mismatch")
VERSION = 1
#: The outcome of an answer that may be graded.
ANSWERED = "answered"


def judged(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Per request and response: outcome, usage (input_tokens, output_tokens, cost_usd) and edits.

    ``requests`` has trial_id, request_hash, model, max_output_tokens and
    editable_files (array); ``responses`` has trial_id and body, a text that
    should be JSON.  The first that holds is the outcome:

    * ``missing_response``: there is none
    * ``invalid_response``: no object of version 1, another model or request hash than the request's, or a usage that
      is neither null nor an object of counters: null, or from 0 on; tokens are whole, costs finite
    * what the runner reports: ``rate_limited``, ``provider_error``, ``invalid_response``, ``model_mismatch``
    * ``invalid_response``: not ``ok``, or edits that are no object
    * ``budget_violation``: more output tokens than the request allows
    * ``invalid_candidate``: edits of a file that isn't editable, or to what is no text
    * ``answered``

    Usage is kept from the second point on: a bad answer was paid for.  It is
    null where unknown.  A request with several responses has a row for each;
    responses to unknown trials have none; null trials are answered by nothing.
    """
    v = F.col("v")
    rows = requests.select("trial_id", "request_hash", "model", "max_output_tokens", "editable_files").join(responses.select("trial_id", F.col("body"), U.parsed("body").alias("v"), F.lit(True).alias("_met")), "trial_id", "left")
    foreign = ~U.is_a(v, "$", "OBJECT") | ~F.coalesce(U.whole_at(v, "$.schema_version") == VERSION, F.lit(False)) | ~_same(v, "model") | ~_same(v, "request_hash")
    bad_usage = ~F.coalesce(U.kind(v, "$.usage").isin("OBJECT", "VOID"), F.lit(True)) | _bad(v, "input_tokens", True) | _bad(v, "output_tokens", True) | _bad(v, "cost_usd", False)
    edits = U.object_at(v, "$.edits")
    pairs = F.transform(F.map_entries(edits), lambda e: F.struct(e["key"].alias("path"), U.text_at(e["value"], "$").alias("content")))
    out = rows.withColumns({
        "missing": F.col("_met").isNull(), "unusable": F.coalesce(foreign | bad_usage, F.lit(True)), "status": U.text_at(v, "$.status"), "has_edits": edits.isNotNull(), "edits": pairs,
        "input_tokens": U.whole_at(v, "$.usage.input_tokens"), "output_tokens": U.whole_at(v, "$.usage.output_tokens"), "cost_usd": U.number_at(v, "$.usage.cost_usd"),
    })
    unfit = F.exists("edits", lambda e: e["content"].isNull() | ~F.array_contains(F.coalesce("editable_files", F.array().cast("array<string>")), e["path"]))
    outcome = U.first_rule([
        ("missing_response", F.col("missing")), ("invalid_response", F.col("unusable")), *[(r, F.col("status") == r) for r in REPORTED],
        ("invalid_response", ~F.coalesce(F.col("status") == "ok", F.lit(False)) | ~F.col("has_edits")), ("budget_violation", F.col("output_tokens") > F.col("max_output_tokens")), ("invalid_candidate", unfit),
    ], ANSWERED)
    told = out.withColumn("outcome", outcome)
    known = ~F.col("missing") & ~F.col("unusable")
    return told.select("trial_id", "request_hash", "outcome", *[F.when(known, F.col(c)).alias(c) for c in ("input_tokens", "output_tokens", "cost_usd")], F.when(F.col("outcome") == ANSWERED, F.col("edits")).alias("edits"))


def _same(v: Column, name: str) -> Column:
    return F.coalesce(U.text_at(v, f"$.{name}") == F.col(name), F.lit(False))


def _bad(v: Column, name: str, whole: bool) -> Column:
    """Whether a counter is neither absent, nor null, nor a number that counts."""
    path = f"$.usage.{name}"
    value = U.whole_at(v, path) if whole else U.number_at(v, path)
    good = F.coalesce((value >= 0) & (value.cast("double") < float("inf")), F.lit(False))
    return U.is_a(v, "$.usage", "OBJECT") & F.coalesce(U.kind(v, path) != "VOID", F.lit(False)) & ~good
