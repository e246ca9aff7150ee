"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a hash, form one stream of words that is
cut into blocks of equal size.  The schedule's slots are golden-ratio points;
a point's place in the cumulative weights names the slot's source.  The r-th
slot of a source takes the r-th block of its stream, and begins anew after the
last.  So any stretch of the schedule holds the sources near their weights.
DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import located, materialize, named, of_row, text_or_empty

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    #: Weights of the sources in order, repeating.
    weights: tuple[int, ...] = (1, 2, 3)
    #: A source, and a document, is taken so many times at most.
    repeats: int = 3
    #: Words of a block; smaller where a source would have fewer than ``blocks`` on average.
    block: int = 256
    blocks: int = 8192
    seed: str = "0"
    #: Rows that one task orders, about.
    bucket: int = 4_000
    #: Slots that one task ranks.
    chunk: int = 1 << 16
    #: Cells of the grid over [0, 1) by which slots find their source.
    cells: int = 1024


def targets(sized: DataFrame, settings: Settings) -> DataFrame:
    """Per source of (source, size): sid, source_size, target.

    Sources in code point order, null last, have the weights in turn and share
    all words by weight; what exceeds ``repeats`` times a source's size is
    shared again until none exceeds it.  With the sources in order of their
    limit per weight, that level is found in one pass.
    """
    w = settings.weights
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in w]), ((F.col("sid") - 1) % len(w) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "sid")  # a row per source
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    first = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * float(settings.repeats))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    total = F.sum("source_size").over(first)
    return (
        ranked.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("open", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(first))
        .withColumn("target", F.when(F.struct("ratio", "sid") < F.struct("open.ratio", "open.sid"), F.col("limit")).otherwise(F.coalesce(F.col("open.level") * F.col("weight"), F.col("limit"))))
        .select("source", "sid", "source_size", "target")
    )


def mix(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), keys: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source", shuffled_by: tuple[str, ...] | None = None) -> DataFrame:
    """Per row: ``keys``, size, source_size, target and taken.

    Sizes are words; a null text has none, and a document without words is
    taken 0 times.  A null source is a source of its own.  Equal rows are taken
    each for itself; other columns are not read; an empty table gives an empty
    one.  A source's stream is in order of a hash of ``shuffled_by`` (``keys``
    where not given), then of ``keys`` and size: with keys that belong to the
    rows, the result depends on the rows alone, not on how they are partitioned.
    """
    # one pass over the texts; what follows is narrow
    order = F.md5(F.concat_ws(":", F.lit(settings.seed), *[F.col(k).cast("string") for k in shuffled_by or keys]))
    sized = materialize(spark, docs.select(*named(keys), F.col(source).alias("source"), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"), order.alias("h")), "mix-sizes")
    per_source = materialize(spark, targets(sized, settings), "mix-sources")
    r = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count("*").alias("rows")).first()
    size = max(1, min(settings.block, r.total // (settings.blocks * max(1, per_source.count()))))
    blocks = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.floor(F.col("source_size") / size))).otherwise(0)
    per_source = per_source.withColumn("blocks", blocks.cast("long")).withColumn("slots", F.when(F.col("blocks") > 0, F.col("target") / (F.col("source_size") / F.col("blocks"))).otherwise(0.0))
    slots = per_source.agg(F.sum("slots")).first()[0] or 0.0

    placed = _placed(_with_source(sized, per_source), r.rows, settings, keys)
    times = _schedule(spark, per_source, slots, settings)
    full = placed.where(F.col("size") > 0)
    pieces = full.withColumn("block", F.explode(F.sequence(_block_of(F.col("start")), _block_of(F.col("start") + F.col("size") - 1))))
    begin, end = _block_start(F.col("block")), _block_start(F.col("block") + 1)
    words = F.least(F.col("start") + F.col("size"), end) - F.greatest(F.col("start"), begin)
    taken = (
        pieces.withColumn("words", words).join(times, ["sid", "block"], "left")
        .groupBy("sid", "start", *named(keys), "size", "source_size", "target")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    )
    out = [*named(keys), "size", "source_size", "target", "taken"]
    empty = placed.where(F.col("size") == 0).withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*out).unionByName(empty.select(*out))


def _with_source(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    sources = per_source.select(F.col("source").alias("_s"), "sid", "source_size", "target", "blocks")
    return sized.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")


def _placed(sized: DataFrame, rows: int, settings: Settings, keys: tuple[str, ...]) -> DataFrame:
    """Add ``start``: the words before a document in its source's stream, in order of hash.

    In two steps, so that no task orders a whole source: sums of what shares
    the hash's first digits, then the order among these.
    """
    digits = max(1, min(8, math.ceil(math.log(max(1, rows / settings.bucket), 16))))
    part = sized.withColumn("part", F.substring("h", 1, digits))
    ahead = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = part.groupBy("sid", "part").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("sid", "part", "base")
    within = Window.partitionBy("sid", "part").orderBy("h", *named(keys), "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = part.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return inner.join(base, ["sid", "part"]).withColumn("start", F.col("base") + F.col("within")).drop("part", "base", "within", "h")


def _block_of(word):
    """Block of a word of the stream; the first ``source_size % blocks`` blocks have one word more."""
    return F.when(word < _longer() * (_short() + 1), _div(word, _short() + 1)).otherwise(_longer() + _div(word - _longer() * (_short() + 1), _short()))


def _block_start(block):
    return block * _short() + F.least(block, _longer())


def _short():
    return _div(F.col("source_size"), F.col("blocks"))


def _longer():
    return F.col("source_size") % F.col("blocks")


def _div(a, b):
    return F.call_function("div", a, b)


def _schedule(spark: SparkSession, per_source: DataFrame, slots: float, settings: Settings) -> DataFrame:
    """(sid, block, times): how often the schedule's slots take a block."""
    n = round(slots)
    ahead = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # a row per source
    share = F.col("slots") / max(slots, 1e-300)
    spans = (
        per_source.where(F.col("slots") > 0).withColumn("low", F.coalesce(F.sum(share).over(ahead), F.lit(0.0)))
        .withColumn("high", F.coalesce(F.lead("low").over(Window.orderBy("sid")), F.lit(1.0)))
        .select("sid", "blocks", "low", "high")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * settings.cells), F.floor(F.least(F.col("high") * settings.cells, F.lit(settings.cells - 1.0))))))
    )
    point = (F.col("id") + 1) * GOLDEN
    points = spark.range(n).withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * settings.cells))
    found = points.join(spans, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    found = found.withColumn("chunk", F.floor(F.col("id") / settings.chunk)).select("id", "chunk", "sid", "blocks")
    # ranks in two steps: slots of earlier chunks, then the order within the chunk
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("sid", "chunk").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("sid", "chunk", "base")
    within = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("id")) - 1
    ranked = found.withColumn("within", within).join(base, ["sid", "chunk"]).withColumn("rank", F.col("base") + F.col("within"))
    # a slot beyond a source's last permitted pass stays empty
    return (
        ranked.where(F.col("rank") < F.col("blocks") * settings.repeats).withColumn("block", F.col("rank") % F.col("blocks"))
        .groupBy("sid", "block").agg(F.count("*").alias("times"))
    )


def mixed_rows(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows that the mix takes, with all their columns, repeated as often as it takes them.

    A row that is taken in part counts if at least half of its words are.
    Rows without words (null, empty or white texts) are taken 0 times; an empty
    table gives an empty one.  Streams are shuffled by the key and digests of
    the text and of the whole row, so only rows that are equal in every column
    can change places: the result is the same wherever and in whatever order
    the rows are stored.  (Columns of maps and variants are in no digest.)
    """
    plain = [f.name for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    at = located(spark, docs)
    digests = [F.sha2(text_or_empty(of_row(text)), 256).alias("_text"), F.xxhash64(*[of_row(c) for c in plain]).alias("_all")]
    slim = at.select("_file", "_row", of_row(key).cast("string").alias("_key"), *digests, of_row(text).alias("text"), of_row(source).alias("source"))
    taken = mix(spark, slim, settings, keys=("_file", "_row"), shuffled_by=("_key", "_text", "_all"))
    copies = taken.select("_file", "_row", F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int").alias("_copies")).where("_copies > 0")
    rows = at.join(copies, ["_file", "_row"])
    return rows.select("r", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("r.*")
