"""Packing whole sections under a budget, skipping what doesn't fit.

A running sum can't skip, so the order is folded on the driver, in rounds.  What
doesn't fit beside what is used doesn't fit later either, so a round takes only
the next sections in order that still may fit, wherever they stand; the tables
are not bounded.  What is kept is bounded by the budget.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..storage import stage

#: Sections that come to the driver in a round.
ROUND = 4096


def _rounds(rows: DataFrame, order: list[str], may_fit: Callable[[], Column], step: Callable[[Row], bool]) -> None:
    """Call ``step`` on the rows that may fit, in order, until none is left.

    A true result says that more may fit than before: a new round begins after that row.
    """
    at = None
    while True:
        left = rows.where(may_fit())
        if at is not None:
            left = left.where(F.struct(*order) > F.struct(*[F.lit(at[c]).cast(rows.schema[c].dataType).alias(c) for c in order]))
        taken = left.orderBy(*order).limit(ROUND).collect()
        for at in taken:
            if step(at):
                break
        else:
            if len(taken) < ROUND:
                return


def _placed(rows: DataFrame, kept: list[tuple], start: int, flag: str, total: str) -> DataFrame:
    """All rows (pos, id), whether each is among ``kept`` (pos, id, nth, total), and the total after it."""
    shared = rows.sparkSession.sparkContext.broadcast(([k[:3] for k in kept], [k[3] for k in kept]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals = shared.value
        for batch in batches:
            own = [(pos, id_ or "", nth) for pos, id_, nth in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            at = [bisect_right(keys, k) - 1 for k in own]
            flags = [i >= 0 and keys[i] == k for i, k in zip(at, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.bool_()), pa.array([totals[i] if i >= 0 else start for i in at], pa.int64())], ["pos", "id", flag, total])

    return rows.select("pos", "id", "nth").mapInArrow(found, f"pos long, id string, {flag} boolean, {total} long")


def pack(sections: DataFrame, header_bytes: int, budget: int, reserve: int = 0) -> DataFrame:
    """Per section (pos, id, bytes, seed, free?, needs?): whether it is kept, and the bytes used after it.

    A section fits if the text's bytes with it, over three and rounded up, are
    at most the budget less the reserve.  A seed that fits only without the
    reserve ends the reserve for good.  ``free`` sections are what the reserve
    is held for: they need not leave it.  A section that ``needs`` another id
    is kept only after that one.  The order is by pos and id.
    """
    optional = {"free": "boolean", "needs": "string"}
    extra = [F.col(c).cast(t).alias(c) if c in sections.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    rows = sections.select(F.col("pos").cast("long").alias("pos"), F.col("id").cast("string").alias("id"), F.col("bytes").cast("long").alias("bytes"), F.coalesce("seed", F.lit(False)).alias("seed"), *extra)
    rows = stage(rows.withColumn("free", F.coalesce("free", F.lit(False))).withColumn("nth", F.monotonically_increasing_id()), "sections-to-pack")
    used, kept, ids = header_bytes, [], set()

    def may_fit() -> Column:
        cost = F.ceil((F.col("bytes") + used) / 3)
        return (cost <= budget - reserve) | (F.col("seed") | F.col("free")) & (cost <= budget)

    def step(r: Row) -> bool:
        nonlocal used, reserve
        cost = -(-(used + r.bytes) // 3)
        freed = r.seed and budget - reserve < cost <= budget
        if freed:
            reserve = 0
        if cost <= budget - reserve * (not r.free) and (r.needs is None or r.needs in ids):
            used += r.bytes
            kept.append((r.pos, r.id or "", r.nth, used))
            ids.add(r.id)
        return freed

    _rounds(rows, ["pos", "id", "nth"], may_fit, step)
    return _placed(rows, kept, header_bytes, "kept", "used")


def pack_each(sections: DataFrame, group: str, header_bytes: int, budget: int) -> DataFrame:
    """As ``pack``, for many short lists at once: adds ``kept`` and ``used`` to the sections (pos, bytes) of each group.

    A group is one row while it is folded, so its sections must be few, as the
    best of a search are; they carry no texts.  There are no seeds and no reserve.
    """
    others = [c for c in sections.columns if c not in (group, "pos")]
    listed = sections.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", *others))).alias("s"))
    start = F.struct(F.lit(header_bytes).cast("long").alias("used"), F.array().cast("array<struct<kept:boolean,used:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        after = acc["used"] + x["bytes"].cast("long")
        fits = F.coalesce(F.ceil(after / 3) <= budget, F.lit(False))
        used = F.when(fits, after).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct(fits.alias("kept"), used.alias("used")))).alias("out"))

    folded = listed.select(group, F.arrays_zip("s", F.aggregate("s", start, step)["out"].alias("out")).alias("z"))
    return folded.select(group, F.inline("z")).select(group, "s.*", "out.*")


def reserved(notes: DataFrame, limit: int) -> DataFrame:
    """Per note (pos, id, cost): whether it is in the reserve of ``limit``, and the reserve so far."""
    rows = notes.select(F.col("pos").cast("long").alias("pos"), F.col("id").cast("string").alias("id"), F.col("cost").cast("long").alias("cost"))
    rows = stage(rows.withColumn("nth", F.monotonically_increasing_id()), "notes-to-reserve")
    total, kept = 0, []

    def step(r: Row) -> bool:
        nonlocal total
        if total + r.cost <= limit:
            total += r.cost
            kept.append((r.pos, r.id or "", r.nth, total))
        return False

    _rounds(rows, ["pos", "id", "nth"], lambda: F.col("cost") + total <= limit, step)
    return _placed(rows, kept, 0, "reserved", "sum")


def distinct_in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    """First occurrences: each value once, with the least ``order``."""
    return rows.groupBy(value).agg(F.min(order).alias(order))


def files_in_order(matches: DataFrame, files: DataFrame, header_bytes: int, budget: int) -> DataFrame:
    """Whole files (path, bytes) in the order of their first match (path, pos), packed."""
    first = stage(distinct_in_order(matches, "path", "pos").join(files, "path").select("pos", F.col("path").alias("id"), "bytes", F.lit(False).alias("seed")), "files-to-pack")
    return pack(first, header_bytes, budget)
