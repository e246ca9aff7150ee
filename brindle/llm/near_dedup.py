"""Near-duplicate detection: one-permutation MinHash, banded buckets, star candidates.

1. Each text becomes its set of hashed word shingles.  One hash orders a set;
   its range is cut into bins, and a bin's value is its least hash.  An empty
   bin borrows from the first filled one along a fixed random order of bins
   (optimal densification).  Runs of bins make a document's buckets.
2. Equal sets become one node, so exact copies cost nothing from here on.
3. In each bucket one node is the centre of a star: candidates are its pairs
   with the bucket's other nodes, as many as there are nodes.  The centre is
   the node that meets most others, which links most of its group at once.
4. Candidates are confirmed on the full sets of the two texts: of every text
   that is in a pair the hashed set is made once, and pairs intersect these in
   the JVM.  Components of the links are found by alternating stars; later
   links only join the components of earlier ones.
5. Nodes that were no centre, in buckets where these are still in different
   components, get an exact second filter, so that no link within a bucket is
   lost: two sets that are similar enough share one of the rarest shingles of
   each (its prefix).  Shingles that no other such node has fall away, and with
   them nearly all pairs that aren't similar enough.  Each prefix shingle is
   then a bucket for rounds of stars, without the nodes that were centres and
   with more centres each time (64, then eight times as many), until every pair
   of a bucket was compared or is connected.  A pair is compared only if its
   sizes, the places of the shingle in both orders and, for nodes that were
   compared with the same centre in the first round, what each gained and lost
   against that centre leave room for a link (see ``_may_link``).

Equal sets, a bucket or a centre may have a third of all rows: counts and
centres are combined per task before they are shuffled, and joins on such a key
are left to Spark to split (``forceOptimizeSkewedJoin``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import held, located, materialize, of_row, settings_of, workers_import_this


@dataclass(frozen=True)
class Settings:
    """Links need ``100 * intersection >= percent * union``.

    A pair at 85 % agrees in a band of 5 bins with probability 0.44, and in
    none of 28 bands with 1e-7.
    """

    words: int = 3
    percent: int = 85
    bands: int = 28
    rows: int = 5
    seed: int = 20

    @property
    def bins(self) -> int:
        return self.bands * self.rows


#: The pipeline's and the library's own setting.
STANDARD = Settings(words=5, percent=80, bands=40)


class Hasher:
    """Shingle sets and buckets of texts; the same in every process."""

    #: Words whose hashes a worker remembers before it starts afresh.
    CACHE = 50_000

    def __init__(self, settings: Settings):
        self.settings = settings
        rng = np.random.Generator(np.random.PCG64(settings.seed))
        odd = lambda n: rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.word_factors, self.band_factors, self.band_terms = odd(settings.words), odd(settings.rows), odd(settings.bands)
        self.short = odd(settings.words)
        edges = [(k << 64) // settings.bins for k in range(settings.bins)]
        self.edges = np.array(edges, np.uint64)
        self.order = np.stack([rng.permutation(settings.bins) for _ in range(settings.bins)])
        self.words = _Words()

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes of a text's shingles; A-Z count as a-z, words end at ASCII white space."""
        words = text.lower().split()
        if len(self.words) > self.CACHE:
            self.words.clear()
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        size = self.settings.words
        if len(w) >= size:
            h = sum(w[k : len(w) - size + 1 + k] * self.word_factors[k] for k in range(size))
        elif len(w):
            h = (w * self.word_factors[: len(w)]).sum(keepdims=True) ^ self.short[len(w)]
        else:
            return w
        return np.unique(_mixed(h))

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        start = np.searchsorted(shingles, self.edges)
        filled = np.append(start[1:], len(shingles)) > start
        empty = np.flatnonzero(~filled)
        values = shingles[np.minimum(start, len(shingles) - 1)]
        if len(empty):
            donors = self.order[empty]
            first = filled[donors].argmax(axis=1)
            values[empty] = values[donors[np.arange(len(empty)), first]]
        bands = values.reshape(self.settings.bands, self.settings.rows) * self.band_factors
        return _mixed(bands.sum(axis=1) ^ self.band_terms).view(np.int64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hasher(settings: Settings) -> Hasher:
    return held(("near", settings), lambda: Hasher(settings))


def features(at: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """Per row of ``located`` documents: key, place, set size, set digest, buckets."""
    slim = at.select(of_row(text).alias("text"), of_row(key).alias("key"), "_file", "_row")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(settings)
        for batch in batches:
            sizes, digests, buckets, offsets = [], [], [], [0]
            for t in batch.column(0):
                s = own.shingles(t.as_buffer().to_pybytes()) if t.is_valid else np.zeros(0, np.uint64)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    buckets.append(own.buckets(s))
                offsets.append(offsets[-1] + settings.bands * bool(len(s)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(buckets) if buckets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["key", "_file", "_row", "size", "digest", "buckets"])

    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(hashed, f"key {kind}, _file string, _row long, size long, digest binary, buckets array<long>")


def sets_of(nodes: DataFrame, wanted: DataFrame, at: DataFrame, settings: Settings, text: str) -> DataFrame:
    """(node, set) of the wanted nodes (node), from the rows that stand for them."""
    places = nodes.join(wanted, "node", "left_semi").select("node", F.col("first.file").alias("_file"), F.col("first.row").alias("_row"))
    texts = at.select("_file", "_row", of_row(text).alias("text")).join(places, ["_file", "_row"]).select("node", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hasher(settings)
        for batch in batches:
            sets = [own.shingles(t.as_buffer().to_pybytes()).view(np.int64) for t in batch.column(1)]
            offsets = np.cumsum([0, *map(len, sets)])
            lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(pa.list_(pa.int64()))], ["node", "set"])

    return texts.mapInArrow(cut, "node long, set array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of nodes, with ``linked``: their full sets (node, set) are intersected."""
    first = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    second = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    linked = 100 * both >= settings.percent * (F.size("set_a") + F.size("set_b") - both)
    return pairs.select("a", "b").join(second, "b").join(first, "a").select("a", "b", linked.alias("linked"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (a, b); a component is its least node.

    Alternates large and small stars until no edge changes.  Minima are
    combined per task before they are shuffled, and no list of neighbours is
    ever held, so a node may have any number of links.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(spark, edges, "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialize(spark, small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def joined(spark: SparkSession, part: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, component) after more links (a, b): only components that these join are looked at."""
    if part is None:
        return components(spark, links)
    of = {c: part.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")}
    ends = links.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = materialize(spark, components(spark, ends), "near-merged")
    known = part.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    fresh = merged.join(part, "node", "left_anti")
    return materialize(spark, known.union(fresh), "near-components")


class _Links:
    """The components of the links found so far, and the pairs that were compared."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, at: DataFrame, settings: Settings, text: str):
        self.spark, self.nodes, self.at, self.settings, self.text = spark, nodes, at, settings, text
        self.part: DataFrame | None = None
        self.compared: DataFrame | None = None
        self.first: DataFrame | None = None
        self.sets: DataFrame | None = None  # of the nodes of the rounds after the first

    def split(self, open_: DataFrame) -> DataFrame | None:
        """The rows, with component, of the buckets that hold several components; None if there are none."""
        if self.part is None:
            live = open_.withColumn("component", F.col("node"))
        else:
            live = open_.join(self.part, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = live.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
        live = materialize(self.spark, live.join(several, "bucket"), "near-live")
        return None if live.isEmpty() else live

    def round(self, open_: DataFrame, centres: int) -> DataFrame | None:
        """A star per centre; returns the rows of the nodes that were no centre, None if all is compared.

        Centres are of the bucket's smallest components, so that what a large
        component has not absorbed is compared with it, not it with them.
        """
        live = self.split(open_)
        if live is None:
            return None
        sizes = live.groupBy("bucket", "component").agg(F.count("*").alias("members"))
        best = Window.partitionBy("bucket").orderBy("members", F.desc("weight"), "node")
        picked = live.join(sizes, ["bucket", "component"]).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= centres)
        picked = materialize(self.spark, picked.select("bucket", F.col("node").alias("centre"), F.col("component").alias("of"), F.col("size").alias("centre_size"), F.col("place").alias("centre_place"), F.col("mark").alias("centre_mark")), "near-centres")
        close = 100 * F.least("size", "centre_size") >= self.settings.percent * F.greatest("size", "centre_size")
        pairs = live.join(picked, "bucket").where((F.col("component") != F.col("of")) & close & _may_link(self.settings)).select(F.col("centre").alias("a"), F.col("node").alias("b"), F.least("centre", "node").alias("low"), F.greatest("centre", "node").alias("high"))
        pairs = pairs.groupBy("low", "high").agg(F.min("a").alias("a"))  # one of the two directions
        pairs = pairs.select("low", "high", "a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
        if self.compared is not None:
            pairs = pairs.join(self.compared, ["low", "high"], "left_anti")
        pairs = materialize(self.spark, pairs, "near-pairs")
        sets = self.sets
        if sets is None:
            asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
            sets = materialize(self.spark, sets_of(self.nodes, asked, self.at, self.settings, self.text), "near-sets")
        judged = materialize(self.spark, confirmed(pairs, sets, self.settings), "near-judged")
        found = judged.where("linked").select("a", "b")
        if not found.isEmpty():
            self.part = joined(self.spark, self.part, found)
        self.first = judged if self.first is None else self.first
        done = pairs.select("low", "high")
        self.compared = done if self.compared is None else self.compared.union(done)
        return live.select("bucket", "node", "size", "weight", "place", "mark").join(picked.select("bucket", F.col("centre").alias("node")), ["bucket", "node"], "left_anti")


#: Longs of a bitmap.
BITMAP = 4
#: A node against a centre: how many shingles it has besides and how many it lacks, and bitmaps of their hashes.
MARK = "struct<pivot:bigint,gained:bigint,lost:bigint,g:array<bigint>,l:array<bigint>>"


def _bitmap(shingle: str) -> Column:
    """Aggregate: the bitmap of a group's hashes."""
    place = F.shiftright(F.col(shingle), 6).bitwiseAND(BITMAP - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(shingle).bitwiseAND(63).cast("int"))
    return F.array(*[F.coalesce(F.bit_or(F.when(place == k, bit)), F.lit(0).cast("long")) for k in range(BITMAP)])


def _may_link(settings: Settings) -> Column:
    """False only for pairs that can't be linked.

    Let two nodes A and B have the same pivot P.  Their symmetric difference is
    that of A - P and B - P (gained) plus that of P - A and P - B (lost).  Each
    bit of A's bitmap that B's lacks is an element of A that B hasn't, so what
    they have in common is at most A's elements less these bits.  A link needs
    a symmetric difference of at most (100 - p) / (100 + p) of both sizes.

    ``place`` is where a bucket's shingle stands in a node's set, rarest first.
    At the first shingle that two nodes share, what they have in common is at
    most that one and all that follows it in the shorter rest; a link needs
    p / (100 + p) of both sizes.  A pair that a later shingle rules out so was
    met at its first.
    """
    a, b = F.col("mark"), F.col("centre_mark")

    def common(n: str, bits: str) -> Column:
        missing = F.lit(0)
        for k in range(BITMAP):
            missing = missing + F.bit_count(a[bits][k].bitwiseAND(F.bitwise_not(b[bits][k])))
        return F.least(a[n] - missing, b[n])

    apart = a["gained"] + b["gained"] - 2 * common("gained", "g") + a["lost"] + b["lost"] - 2 * common("lost", "l")
    room = (100 - settings.percent) * (F.col("size") + F.col("centre_size"))
    in_common = 1 + F.least(F.col("size") - F.col("place"), F.col("centre_size") - F.col("centre_place"))
    placed = F.coalesce((100 + settings.percent) * in_common >= settings.percent * (F.col("size") + F.col("centre_size")), F.lit(True))
    return placed & F.coalesce((a["pivot"] != b["pivot"]) | ((100 + settings.percent) * apart <= room), F.lit(True))


def pivots(spark: SparkSession, live: DataFrame, first: DataFrame) -> DataFrame:
    """(node, pivot): of the centres that a node was compared with in the first round, the one most of them share."""
    own = first.select(F.col("b").alias("node"), F.col("a").alias("pivot")).join(live, "node")
    popular = own.groupBy("pivot").agg(F.count("*").alias("nodes"))
    chosen = own.join(popular, "pivot").groupBy("node").agg(F.max(F.struct("nodes", "pivot")).alias("best")).select("node", "best.pivot")
    return materialize(spark, chosen, "near-pivots")


def prefixes(spark: SparkSession, live: DataFrame, sets: DataFrame, chosen: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, node, size, weight, place, mark): the prefix shingles of the nodes that another of them has too.

    With shingles in order of how many of these nodes have them, a set of n
    has a prefix of n - ceil(n * percent / 100) + 1.  ``sets`` has those of
    the nodes and of the pivots (see ``pivots``).
    """
    every = sets.select("node", F.size("set").cast("long").alias("size"), F.explode("set").alias("bucket"))
    shingles = every.join(live, "node", "left_semi")
    common = shingles.groupBy("bucket").agg(F.count("*").alias("weight")).where("weight > 1")
    ranked = shingles.join(common, "bucket", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    rarest = Window.partitionBy("node").orderBy("weight", "bucket")
    length = F.col("size") - F.floor((F.col("size") * settings.percent + 99) / 100) + 1
    prefix = ranked.withColumn("nth", F.row_number().over(rarest)).where((F.col("nth") <= length) & (F.col("weight") > 1))

    base = every.join(chosen.select(F.col("pivot").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("pivot"), "bucket")
    own = shingles.join(chosen.select("node", "pivot"), "node").select("pivot", "bucket", "node")
    gained = own.join(base, ["pivot", "bucket"], "left_anti").groupBy("node").agg(F.count("*").alias("gained"), _bitmap("bucket").alias("g"))
    lacked = chosen.select("node", "pivot").join(base, "pivot").join(own, ["pivot", "bucket", "node"], "left_anti")
    lost = lacked.groupBy("node").agg(F.count("*").alias("lost"), _bitmap("bucket").alias("l"))
    none, zero = F.array(*[F.lit(0).cast("long")] * BITMAP), F.lit(0).cast("long")
    marks = chosen.join(gained, "node", "left").join(lost, "node", "left")
    mark = F.struct("pivot", F.coalesce("gained", zero).alias("gained"), F.coalesce("lost", zero).alias("lost"), F.coalesce("g", none).alias("g"), F.coalesce("l", none).alias("l"))
    marks = marks.select("node", mark.cast(MARK).alias("mark"))
    return materialize(spark, prefix.select("bucket", "node", "size", "weight", F.col("nth").cast("long").alias("place")).join(marks, "node", "left"), "near-prefixes")


def link_components(spark: SparkSession, at: DataFrame, settings: Settings, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Features of all rows, and (digest, component key, place of the row that stays) of all sets."""
    workers_import_this(spark)
    # whole texts go to Python: bytes, not rows, bound what a task holds
    ours = {"spark__sql__execution__arrow__maxRecordsPerBatch": "1000", "spark__sql__execution__arrow__maxBytesPerBatch": str(4 << 20), "spark__sql__adaptive__forceOptimizeSkewedJoin": "true"}
    with settings_of(spark, **ours):
        return _link_components(spark, at, settings, key, text)


def _link_components(spark: SparkSession, at: DataFrame, settings: Settings, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(spark, features(at, settings, key, text), "near-features")
    first = F.struct(F.col("key").isNull().alias("nameless"), F.col("key").alias("key"), F.col("_file").alias("file"), F.col("_row").alias("row"))
    alike = rows.where("size > 0").groupBy("digest").agg(F.min(first).alias("first"), F.first("size").alias("size"))
    nodes = materialize(spark, alike.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    # a row per bucket of a node, from the row that stands for it
    own = rows.select("digest", "_file", "_row", "buckets").join(nodes.select("node", "size", F.col("first.file").alias("_file"), F.col("first.row").alias("_row")), ["_file", "_row"])
    spread = materialize(spark, own.select("node", "size", F.explode("buckets").alias("bucket")), "near-buckets")
    met = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(spark, spread.join(met, "bucket"), "near-shared")
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    open_ = shared.join(weight, "node").select("bucket", "node", "size", "weight", F.lit(None).cast("long").alias("place"), F.lit(None).cast(MARK).alias("mark"))

    state = _Links(spark, nodes, at, settings, text)
    rest = state.round(open_, 1)
    if rest is not None and (split := state.split(rest)) is not None:
        live = materialize(spark, split.select("node").distinct(), "near-rest")
        chosen = pivots(spark, live, state.first)
        asked = live.union(chosen.select(F.col("pivot").alias("node"))).distinct()
        state.sets = materialize(spark, sets_of(nodes, asked, at, settings, text), "near-sets")
        open_, centres = prefixes(spark, live, state.sets, chosen, settings), 64
        while open_ is not None:
            open_, centres = state.round(open_, centres), centres * 8

    part = state.part
    labelled = nodes.select("digest", "node", "first")
    labelled = labelled.withColumn("component", F.col("node")) if part is None else labelled.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stays = labelled.groupBy("component").agg(F.min("first").alias("stays"))
    return rows, labelled.join(stays, "component").select("digest", "stays")


def deduplicate(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id, kept.

    A text without words, or null, has no shingles and is linked with nothing.
    Rows that are equal, or have equal sets, are one component; null keys come
    after all others.  ``kept`` says that the row's key is its component's.  An
    empty table gives an empty one; other columns are not read.
    """
    rows, sets = link_components(spark, located(spark, docs), settings, key, text)
    found = rows.where("size > 0").join(sets, "digest").select("key", "size", F.col("stays.key").alias("component_id"))
    every = found.union(rows.where("size = 0").select("key", "size", F.col("key").alias("component_id")))
    return every.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, settings: Settings = STANDARD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay: one of each component, and every text without words.

    Of a component the row with the smallest key stays, null keys last, then
    the first by place.  An empty table gives an empty one.
    """
    at = located(spark, docs)
    rows, sets = link_components(spark, at, settings, key, text)
    stays = sets.select(F.col("stays.file").alias("_file"), F.col("stays.row").alias("_row")).distinct()
    wordless = rows.where("size = 0").select("_file", "_row")
    return at.join(stays.union(wordless), ["_file", "_row"], "left_semi").select("r.*")
