"""Summaries of paired runs and of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

# The outcomes that count as scored; the conditions of trials, the first four by default, and
# what a trial's packet is made of: whole files or an investigation by a retrieval policy, and the note it is given;
# the pairs of conditions whose scored trials are compared (baseline, contender).
SCORED = ("passed", "test_failed", "timeout", "invalid_candidate")
TREATMENTS = {
    "lexical": ("files", None), "graph": ("legacy", None), "memory": ("legacy", "fresh"), "stale_memory": ("legacy", "stale"),
    "hybrid": ("hybrid", None), "hybrid_memory": ("hybrid", "fresh"), "hybrid_stale_memory": ("hybrid", "stale"),
}
CONDITIONS = tuple(TREATMENTS)
DEFAULT_CONDITIONS = CONDITIONS[:4]
PAIRS = (
    ("lexical", "graph"), ("graph", "memory"), ("graph", "stale_memory"), ("graph", "hybrid"), ("memory", "hybrid_memory"),
    ("stale_memory", "hybrid_stale_memory"), ("hybrid", "hybrid_memory"), ("hybrid", "hybrid_stale_memory"),
)


def condition_summary(trials: DataFrame, scored: Column, passed: Column) -> DataFrame:
    """Per condition: completed, scored, passed, unscored and the rate of passes (null if none is scored)."""
    return trials.groupBy("condition").agg(
        F.count("*").alias("completed"), F.count_if(scored).alias("scored"), F.count_if(passed).alias("passed"),
        F.count_if(~scored).alias("unscored"),
    ).withColumn("success_rate", F.try_divide("passed", "scored"))


def paired_wins(trials: DataFrame, pairs: DataFrame, scored: Column, passed: Column) -> DataFrame:
    """Per pair (baseline, contender): tasks scored in both, and which of the two alone passed.

    ``trials`` has one row per task and condition.
    """
    rows = trials.where(scored).select("task", "condition", passed.alias("passed"))
    left = rows.select("task", F.col("condition").alias("baseline"), F.col("passed").alias("l"))
    right = rows.select("task", F.col("condition").alias("contender"), F.col("passed").alias("r"))
    met = left.join(F.broadcast(pairs), "baseline").join(right, ["task", "contender"])
    return met.groupBy("baseline", "contender").agg(F.count("*").alias("matched"), F.count_if(F.col("r") & ~F.col("l")).alias("contender_only"), F.count_if(F.col("l") & ~F.col("r")).alias("baseline_only"))


def null_strict_sum(column: str) -> Column:
    """The sum; null if any value is, or there is none."""
    return F.when((F.count(F.lit(1)) == F.count(column)) & (F.count(F.lit(1)) > 0), F.sum(column))


def outcome_histogram(trials: DataFrame) -> DataFrame:
    return trials.groupBy("condition", "outcome").agg(F.count("*").alias("n"))


def pending(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned trials (request_hash) that have no scored row: what a resumed run still does."""
    return planned.join(done.where(F.col("outcome").isin(*SCORED)).select("request_hash"), "request_hash", "left_anti")


def ranked_where_needed(scores: DataFrame, selected: int) -> DataFrame:
    """From all scored rows (case, id, score, expected), those that ``retrieval_quality`` looks at.

    These are the ``selected`` best of each case and all expected ones, with
    ranks for the best and for the first expected row; the others have none.
    No case is sorted as a whole: each task passes on its best rows, and what
    stands before the first expected row is counted.
    """
    scores = stage(scores, "case-scores")
    best = Window.partitionBy("case").orderBy(F.desc("score"), "id")
    top = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= selected).withColumn("selected", F.lit(True))
    first = scores.where("expected").groupBy("case").agg(F.min(F.struct((-F.col("score")).alias("less"), "id")).alias("first"))
    before = F.struct((-F.col("score")).alias("less"), "id") < F.col("first")
    place = scores.join(F.broadcast(first), "case").groupBy("case", F.col("first.id").alias("id")).agg((F.count_if(before) + 1).alias("place"))  # a row per case
    others = scores.where("expected").join(top.select("case", "id"), ["case", "id"], "left_anti").join(F.broadcast(place), ["case", "id"], "left")
    return top.select("case", "id", "rank", "expected", "selected").unionByName(others.select("case", "id", F.col("place").alias("rank"), "expected", F.lit(False).alias("selected")))


def retrieval_quality(ranked: DataFrame) -> DataFrame:
    """Per case (case, id, rank, expected, selected): recall, precision and reciprocal rank.

    Null where there is nothing to divide by.
    """
    hit = F.col("expected") & F.col("selected")
    return ranked.groupBy("case").agg(
        F.try_divide(F.count_if(hit), F.count_if("expected")).alias("recall"),
        F.try_divide(F.count_if(hit), F.count_if("selected")).alias("precision"),
        F.when(F.count_if("expected") > 0, F.coalesce(F.try_divide(F.lit(1.0), F.min(F.when(F.col("expected"), F.col("rank")))), F.lit(0.0))).alias("reciprocal_rank"),
    )


def set_recall(expected: DataFrame, found: DataFrame, *methods: str) -> DataFrame:
    """Per case: of the expected ids (case, id), the part that each method found (case, id, method).

    A column ``<method>_recall`` for each of ``methods``, and how many expected
    ids the first of them missed; repeated ids count once; cases that expect
    nothing have no row.
    """
    wanted = expected.select("case", "id").distinct()
    hits = found.groupBy("case", "id").agg(*[F.bool_or(F.col("method") == m).alias(m) for m in methods])
    rows = wanted.join(hits, ["case", "id"], "left").select("case", *[F.coalesce(m, F.lit(False)).alias(m) for m in methods])
    return rows.groupBy("case").agg(*[(F.count_if(m) / F.count("*")).alias(f"{m}_recall") for m in methods], F.count_if(~F.col(methods[0])).alias("missing"))


def mean_reciprocal_rank(quality: DataFrame) -> DataFrame:
    """Over the cases that expect anything."""
    return quality.agg(F.avg("reciprocal_rank").alias("mrr"))


def rotated(tasks: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """(task, condition, seq): every condition for every task, each task starting one later."""
    n = len(conditions)
    listed = F.array(*map(F.lit, conditions))
    turned = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(listed, ((i + F.col("offset")) % n + 1).cast("int")))
    return tasks.select("task", F.posexplode(turned).alias("seq", "condition"))
