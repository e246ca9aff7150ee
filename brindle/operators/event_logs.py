"""Logs of JSON events that a runner wrote: what became of each, its counters and the edits it proposes.

A log counts only if all of it can be read and nothing foreign happened in it.
Logs are aggregated line by line, so one may be as long as it likes: of its
messages only the last is kept, and that is parsed once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import untrusted as U

# Events that may stand in a log, items that are no tool's, counters of a turn.
EVENTS = ("thread.started", "turn.started", "turn.completed", "turn.failed", "error", "item.started", "item.updated", "item.completed")
ITEMS = ("reasoning", "agent_message")
COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
#: Ends of lines.
BREAKS = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"


def lines_of(logs: DataFrame, log: str = "log", text: str = "text") -> DataFrame:
    """(log, seq, line) of whole logs; a null text has one empty line."""
    return logs.select(F.col(log).alias("log"), F.posexplode(F.split(F.coalesce(text, F.lit("")), BREAKS)).alias("seq", "line"))


def outcomes(lines: DataFrame) -> DataFrame:
    """Per log (log, seq, line): status, the counters of its turn, and the edits (path, content) if the status is ``ok``.

    The first that holds:

    * ``invalid_trace``: no line but blank ones, one that is no JSON object, or an event of unknown type
    * ``invalid_usage``: more cached than input tokens
    * ``tool_contamination``: an item that is neither reasoning nor a message
    * ``provider_error``: not exactly one completed turn, or a failed one, or an error
    * ``invalid_candidate``: the last completed message is no object of just ``edits``, an array of objects of just
      ``path`` and ``content``, both strings, or names a path twice
    * ``ok``

    Counters that are no whole numbers from 0 are null; all are null without
    exactly one completed turn that has them, and for the first two outcomes.
    ``has_usage`` says whether there were any.  Lines are in order of ``seq``;
    null lines are blank; a null log is a log.
    """
    e = F.col("e")
    kind = U.text_at(e, "$.type")
    item = U.text_at(e, "$.item.type")
    usage = F.struct(*[_counter(e, c).alias(c) for c in COUNTERS])
    rows = lines.select("log", "seq", "line", F.trim(F.coalesce("line", F.lit("")), F.lit(" \t\n\r\x0b\x0c")).alias("bare")).withColumn("e", U.parsed(F.nullif("bare", F.lit(""))))
    rows = rows.withColumns({"kind": kind, "item": item}).select(
        "log", F.struct("seq", "line").alias("at"), (F.col("bare") != "").alias("said"),
        (~U.is_a(e, "$", "OBJECT") | ~F.coalesce(F.col("kind").isin(*EVENTS), F.lit(False))).alias("strange"),
        F.col("kind").startswith("item.").alias("of_item"), F.coalesce(F.col("item").isin(*ITEMS), F.lit(False)).alias("harmless"),
        (F.col("kind") == "turn.completed").alias("completed"), F.col("kind").isin("turn.failed", "error").alias("failed"),
        F.when(U.is_a(e, "$.usage", "OBJECT"), usage).alias("usage"),
        F.when((F.col("kind") == "item.completed") & (F.col("item") == "agent_message"), F.coalesce(U.text_at(e, "$.item.text"), F.lit(""))).alias("message"),
    )
    said = F.col("said")
    logs = rows.groupBy("log").agg(
        F.count_if(said).alias("lines"), F.bool_or(said & F.col("strange")).alias("strange"), F.bool_or(F.col("of_item") & ~F.col("harmless")).alias("foreign"),
        F.count_if("completed").alias("turns"), F.bool_or("failed").alias("failed"),
        F.max_by("usage", F.when(F.col("completed"), F.col("at"))).alias("usage"), F.max_by("message", F.when(F.col("message").isNotNull(), F.col("at"))).alias("message"),
    )
    logs = logs.withColumn("usage", F.when(F.col("turns") == 1, F.col("usage"))).withColumn("edits", proposed(U.parsed("message")))
    invalid_usage = F.col("usage.cached_input_tokens") > F.col("usage.input_tokens")
    status = U.first_rule([
        ("invalid_trace", (F.col("lines") == 0) | F.col("strange")), ("invalid_usage", invalid_usage), ("tool_contamination", F.col("foreign")),
        ("provider_error", (F.col("turns") != 1) | F.coalesce("failed", F.lit(False))), ("invalid_candidate", F.col("edits").isNull()),
    ], "ok")
    told = logs.withColumn("status", status)
    kept = ~F.col("status").isin("invalid_trace", "invalid_usage")
    return told.select("log", "status", (kept & F.col("usage").isNotNull()).alias("has_usage"), *[F.when(kept, F.col("usage")[c]).alias(c) for c in COUNTERS], F.when(F.col("status") == "ok", F.col("edits")).alias("edits"))


def _counter(e: Column, name: str) -> Column:
    n = U.whole_at(e, f"$.usage.{name}")
    return F.when(n >= 0, n)


def proposed(candidate: Column) -> Column:
    """The edits of a candidate, as array<struct<path, content>>; null if it is malformed."""
    rows = U.list_at(candidate, "$.edits")
    good = F.forall(rows, lambda r: U.has_keys(r, "path", "content") & U.is_a(r, "$.path", "STRING") & U.is_a(r, "$.content", "STRING"))
    edits = F.transform(rows, lambda r: F.struct(F.try_variant_get(r, "$.path", "string").alias("path"), F.try_variant_get(r, "$.content", "string").alias("content")))
    once = F.size(F.array_distinct(F.transform(edits, lambda r: r["path"]))) == F.size(edits)
    return F.when(U.has_keys(candidate, "edits") & F.coalesce(good, F.lit(False)) & F.coalesce(once, F.lit(False)), edits)
