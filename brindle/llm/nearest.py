"""Approximate nearest neighbours by cross-polytope hashing.

A hash is the signed axis nearest to a unit vector after a pseudo-rotation:
three rounds of random signs and a fast Hadamard transform.  A table's bucket
is a tuple of hashes, the more the larger the table, so that buckets stay
small.  A query looks into the buckets whose axes are nearest to it in all of
them.  How many hashes and how many buckets is measured: for a bounded sample of
the queries the true neighbours are found by comparison with all rows, and of
the settings that find the wanted part of these, the one that looks at the
smallest part of the table is taken.  What the buckets hold is ranked exactly, on
the original vectors in double precision.

For the largest inner product, vectors of unequal length get one more component
that makes them equally long, which leaves the order of inner products as the
order of angles.

The first hash of a bucket says which task has it; the others are looked up
there, so a query goes once to each first hash, with all buckets it wants of it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import materialize, workers_import_this


@dataclass(frozen=True)
class Settings:
    neighbours: int = 20
    tables: int = 10
    #: Part of the sample's neighbours that must be found.
    recall: float = 0.96
    #: Queries of the sample; each is compared with all rows.
    sample: int = 64
    #: Buckets of a table that a query looks into, at most, where a bucket has several hashes; with one it may look into all.
    probes: int = 1024
    #: Vectors that a task holds at once; larger buckets are dealt out.
    chunk: int = 1 << 14
    #: Queries of an exact search that are sent to all tasks at once, about.
    block: int = 2048
    #: Width up to which a pseudo-rotation is kept as a matrix.
    narrow: int = 256
    #: Products of vectors that a task computes at once.
    slab: int = 1 << 15
    seed: int = 7


@dataclass(frozen=True)
class Shape:
    """What the hashes need to know of all vectors, and how they look."""

    dimension: int
    longest: float
    #: Whether lengths differ, so that a component is added.
    uneven: bool
    count: int
    #: Hashes of a bucket, and buckets of a table that a query looks into.
    hashes: int = 1
    probes: int = 1

    @property
    def width(self) -> int:
        return 1 << max(0, (self.dimension + self.uneven - 1).bit_length())

    @property
    def axes(self) -> int:
        return 2 * self.width

    @property
    def share(self) -> float:
        """Part of a table's buckets that a query looks into."""
        return self.probes / self.axes**self.hashes


class Hashes:
    def __init__(self, shape: Shape, settings: Settings):
        self.shape, self.settings = shape, settings
        rng = np.random.Generator(np.random.PCG64(settings.seed))
        self.signs = rng.choice(np.array([-1.0, 1.0]), (settings.tables, shape.hashes, 3, shape.width))
        self.places = _places(shape.hashes, shape.probes, shape.axes)
        # narrow vectors: the rounds are applied to the axes once, and a product with the result is faster than the rounds
        self.narrow = [[self._rounds(np.eye(shape.width), t, k) for k in range(shape.hashes)] for t in range(settings.tables)] if shape.width <= settings.narrow else None

    def unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.shape.width))
        d = self.shape.dimension
        if self.shape.uneven and not query:
            out[:, :d] = x / self.shape.longest
            out[:, d] = np.sqrt(np.maximum(0.0, 1.0 - (out[:, :d] ** 2).sum(axis=1)))
        else:
            out[:, :d] = x / np.linalg.norm(x, axis=1)[:, None]
        return out

    def _rounds(self, x: np.ndarray, table: int, nth: int) -> np.ndarray:
        for signs in self.signs[table, nth]:
            x = hadamard(x * signs)
        return x

    def rotated(self, x: np.ndarray, table: int, nth: int) -> np.ndarray:
        return x @ self.narrow[table][nth] if self.narrow else self._rounds(x, table, nth)

    def buckets(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row, the first hash of its bucket and a number for the others."""
        codes = []
        for nth in range(self.shape.hashes):
            y = self.rotated(x, table, nth)
            axis = np.abs(y).argmax(axis=1)
            codes.append(axis + self.shape.width * (y[np.arange(len(y)), axis] < 0))
        return codes[0], _numbered(codes[1:], len(x), self.shape.axes)

    def probed(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``buckets``, a row's buckets side by side, nearest first: those with the largest sum along their axes."""
        order, along = [], []
        for nth in range(self.shape.hashes):
            y = self.rotated(x, table, nth)
            y = np.concatenate([y, -y], axis=1)
            best = np.argsort(-y, axis=1, kind="stable")
            order.append(best)
            along.append(np.take_along_axis(y, best, axis=1))
        sums = sum(a[:, p] for a, p in zip(along, self.places, strict=True))
        best = np.argsort(-sums, axis=1, kind="stable")[:, : self.shape.probes]
        codes = [np.take_along_axis(o, p[best], axis=1) for o, p in zip(order, self.places, strict=True)]
        return codes[0], _numbered(codes[1:], best.shape, self.shape.axes)


def _numbered(codes: list[np.ndarray], shape, axes: int) -> np.ndarray:
    out = np.zeros(shape, np.int64)
    for c in codes:
        out = out * axes + c
    return out


def _places(hashes: int, probes: int, axes: int) -> list[np.ndarray]:
    """Ranks of axes, per hash, of all tuples that can be among the ``probes`` best.

    With every hash's axes in order, a tuple of ranks (from 0) comes after all
    tuples of no larger ranks, so the product of its ranks plus one is at most
    ``probes``.
    """
    tuples = [((), 1)]
    for _ in range(hashes):
        tuples = [((*t, i), n * (i + 1)) for t, n in tuples for i in range(min(axes, probes // n))]
    return [np.array([t[k] for t, _ in tuples]) for k in range(hashes)]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        pairs = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def usable(vector: str = "embedding") -> Column:
    """Neither null nor zero, and all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension).astype(np.float64)


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query, its nearest other rows: query_id, rank, vec_id, score.

    Queries are the rows for which ``is_query`` (over ``id``) holds.  Null keys,
    and vectors that are null, zero, not finite or of another dimension than
    most, take no part.  Equal scores rank by key.  Rows with a query's own key
    are not its neighbours; a query key that repeats is searched for once.  A
    query that finds too few in its buckets is compared with all rows.  Other
    columns are not read; an empty table gives an empty one.
    """
    workers_import_this(spark)
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    rows = materialize(spark, rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.min("length").alias("shortest")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes.d).drop("length")

    once = Window.partitionBy("id").orderBy(F.xxhash64("v"))
    queries = rows.where(is_query).withColumn("nth", F.row_number().over(once)).where("nth = 1").select("id", "v")
    queries = materialize(spark, queries, "vector-queries")
    # of equal vectors only the first few keys, each counted once, can be among a query's nearest
    equal = Window.partitionBy("v").orderBy("id")
    distinct = rows.distinct().withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= settings.neighbours + 1).select("id", "v")
    distinct = materialize(spark, distinct, "vectors-to-search")
    shape = Shape(sizes.d, sizes.longest, sizes.shortest < 0.999 * sizes.longest, distinct.count())
    shape = tuned(spark, distinct, queries, shape, settings)
    found = materialize(spark, ranked(candidates(spark, distinct, queries, shape, settings), settings), "neighbours")

    enough = min(settings.neighbours, distinct.select("id").distinct().count() - 1)
    few = queries.join(found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= enough), "id", "left_anti")
    few = materialize(spark, few, "short-queries")
    if few.isEmpty():
        return found
    exact = compared_with_all(spark, distinct, few, shape, settings)
    return found.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(exact)


def tuned(spark: SparkSession, rows: DataFrame, queries: DataFrame, shape: Shape, settings: Settings) -> Shape:
    """The shape with the hashes and probes by which a sample of the queries finds enough of its true neighbours.

    The sample are the queries with the least hashes of their keys.  Of the
    numbers of hashes up to one at which a bucket has about one row, the one
    whose probes are the smallest part of a table is taken; one hash always
    finds everything if it looks into all buckets.
    """
    asked = materialize(spark, queries.orderBy(F.xxhash64("id"), "id").limit(settings.sample), "sample-queries")
    true = compared_with_all(spark, rows, asked, shape, settings).select("query_id", F.col("vec_id").alias("id"))
    met = true.join(rows, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").collect()  # sample x neighbours rows
    if not met:
        return shape
    q, x = np.array([r.q for r in met], np.float64), np.array([r.v for r in met], np.float64)
    best = None
    for hashes in range(1, max(1, round(math.log(max(2, shape.count)) / math.log(shape.axes))) + 1):
        most = replace(shape, hashes=hashes, probes=shape.axes if hashes == 1 else min(settings.probes, shape.axes**hashes))
        places = np.sort(found_at(q, x, Hashes(most, settings)))
        last = places[math.ceil(settings.recall * len(places)) - 1]
        if last < most.probes:
            fit = replace(most, probes=int(last) + 1)
            best = fit if best is None or fit.share < best.share else best
    return best


def found_at(q: np.ndarray, x: np.ndarray, own: Hashes) -> np.ndarray:
    """Per pair of a query and a vector: as which of the query's buckets, counted from 0, the vector's is met in any table."""
    place = np.full(len(q), np.iinfo(np.int64).max)
    asked, member = np.unique(q, axis=0, return_inverse=True)
    unit_q, unit_x = own.unit(asked, True), own.unit(x, False)
    for t in range(own.settings.tables):
        first, rest = own.probed(unit_q, t)
        first_x, rest_x = own.buckets(unit_x, t)
        for i in range(0, len(x), 256):
            m = member[i : i + 256].ravel()
            same = (first[m] == first_x[i : i + 256, None]) & (rest[m] == rest_x[i : i + 256, None])
            place[i : i + 256] = np.minimum(place[i : i + 256], np.where(same.any(axis=1), same.argmax(axis=1), np.iinfo(np.int64).max))
    return place


def ranked(pairs: DataFrame, settings: Settings) -> DataFrame:
    """The best of each query; a row that several buckets gave counts once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = pairs.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= settings.neighbours)
    return best.groupBy("query_id", "rank").agg(F.min("vec_id").alias("vec_id"), F.min("score").alias("score")).select("query_id", "rank", "vec_id", "score")


PAIRS = "query_id long, vec_id long, score double"


def candidates(spark: SparkSession, rows: DataFrame, queries: DataFrame, shape: Shape, settings: Settings) -> DataFrame:
    """(query_id, vec_id, score): of each first hash that a query looks into, the best of its buckets."""
    kind = rows.schema["v"].dataType.simpleString()
    names, schema = ["t", "b", "id", "v", "code", "codes"], f"t int, b long, id long, v {kind}, code long, codes array<long>"

    def filed(slim: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Hashes(shape, settings)
            for batch in batches:
                x = own.unit(_matrix(batch.column(1), shape.dimension), False)
                for t in range(settings.tables):
                    b, code = own.buckets(x, t)
                    columns = [pa.array(np.full(len(b), t, np.int32)), pa.array(b)]
                    yield pa.RecordBatch.from_arrays(columns, names[:2]) if slim else pa.RecordBatch.from_arrays([*columns, batch.column(0), batch.column(1), pa.array(code), pa.nulls(len(b), pa.list_(pa.int64()))], names)

        return run

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query, table and first hash, with the buckets wanted of it."""
        own = Hashes(shape, settings)
        for batch in itertools.chain.from_iterable([b.slice(i, 256) for i in range(0, len(b), 256)] for b in batches):
            x = own.unit(_matrix(batch.column(1), shape.dimension), True)
            for t in range(settings.tables):
                b, code = own.probed(x, t)
                row = np.repeat(np.arange(len(b)), b.shape[1])
                order = np.lexsort((code.ravel(), b.ravel(), row))
                row, b, code = row[order], b.ravel()[order], code.ravel()[order]
                cuts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (b[1:] != b[:-1])))
                take = pa.array(row[cuts])
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(row)), pa.int32()), pa.array(code))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), t, np.int32)), pa.array(b[cuts]), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.zeros(len(cuts), np.int64)), lists], names)

    # as many rows as tables have first hashes; hashing again costs less than keeping every table's copy of the vectors
    counts = rows.mapInArrow(filed(True), "t int, b long").groupBy("t", "b").agg(F.ceil(F.count("*") / settings.chunk).cast("int").alias("chunks"))
    counts = materialize(spark, counts, "bucket-chunks")
    small = F.broadcast(counts) if settings.tables * shape.axes <= 1 << 20 else counts
    dealt = rows.mapInArrow(filed(False), schema).join(small, ["t", "b"]).withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("kind", F.lit(0))
    asked = queries.mapInArrow(asking, schema).join(small, ["t", "b"]).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("kind", F.lit(1))
    group = ["t", "b", "c"]
    both = dealt.select(*group, "kind", "id", "v", "code", "codes").unionByName(asked.select(*group, "kind", "id", "v", "code", "codes"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, its vectors first: these are held, in order of their bucket, and the queries pass."""
        at, parts, full = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            own, x, code = batch.column(4).to_numpy(zero_copy_only=False), _matrix(batch.column(5), shape.dimension), batch.column(6).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[i, :3])
                if key != at:
                    at, parts, full = key, [], None
                if keys[i, 3] == 0:
                    parts.append((code[i:j], own[i:j], x[i:j]))
                    continue
                if full is None and parts:
                    codes, ids, held = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.argsort(codes, kind="stable")
                    full, parts = (codes[order], ids[order], held[order]), []
                if full is not None:
                    wanted = batch.column(7).slice(i, j - i)
                    yield from bucket_pairs(own[i:j], x[i:j], wanted.flatten().to_numpy(zero_copy_only=False), wanted.value_lengths().to_numpy(zero_copy_only=False), *full, settings)

    return both.repartition(*group).sortWithinPartitions(*group, "kind").mapInArrow(compared, PAIRS)


def bucket_pairs(query_ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, n: np.ndarray, codes: np.ndarray, ids: np.ndarray, x: np.ndarray, settings: Settings) -> Iterator[pa.RecordBatch]:
    """For each query the best of the vectors (in order of ``codes``) in the buckets that it wants, ``n`` of them each."""
    low, high = np.searchsorted(codes, wanted, "left"), np.searchsorted(codes, wanted, "right")
    owner, count = np.repeat(np.arange(len(q)), n), high - low
    # whole queries up to a slab of products at a time
    per_query = np.bincount(owner, count, minlength=len(q)).astype(np.int64)
    slab = (np.cumsum(per_query) - 1) // settings.slab
    for s in np.unique(slab[per_query > 0]):
        use = (slab[owner] == s) & (count > 0)
        c = count[use]
        row = np.repeat(owner[use], c)
        col = np.repeat(low[use] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        other = query_ids[row] != ids[col]
        row, col = row[other], col[other]
        score = (q[row] * x[col]).sum(axis=1)
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        nth = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        best = nth <= settings.neighbours  # one more, as an id can come with two vectors
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[row[best]]), pa.array(ids[col[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])


def best_pairs(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, step: int = 64) -> Iterator[pa.RecordBatch]:
    """The k best of ``x`` for each row of ``q`` but itself, and whatever ties with the last.

    Products of matrices only choose; the scores are sums of a row's products,
    which are the same wherever the row stands.
    """
    for i in range(0, len(q), step):
        ask, own = q[i : i + step], query_ids[i : i + step]
        near = ask @ x.T
        near[own[:, None] == ids[None, :]] = -np.inf
        if near.shape[1] > k:
            edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        else:
            edge = np.full(len(ask), -np.inf)
        margin = 1e-9 * (1 + np.abs(near, where=np.isfinite(near), out=np.zeros_like(near)).max(axis=1))
        row, col = np.nonzero((near >= (edge - margin)[:, None]) & np.isfinite(near))
        score = (ask[row] * x[col]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[col]), pa.array(score)], ["query_id", "vec_id", "score"])


def compared_with_all(spark: SparkSession, rows: DataFrame, queries: DataFrame, shape: Shape, settings: Settings) -> DataFrame:
    """The best of the given queries against all rows, ranked, in blocks of about ``settings.block`` queries.

    A block is all that is sent to the tasks at a time, a task holds one batch
    of rows, and a block's result is written before the next one begins.
    """
    blocks = max(1, math.ceil(queries.count() / settings.block))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    out = None
    for n in range(blocks):
        block = dealt.where(F.col("block") == n).collect()  # settings.block rows, about
        if not block:
            continue
        shared = spark.sparkContext.broadcast((np.array([r.id for r in block]), np.array([r.v for r in block], np.float64)))

        def compared(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    yield from best_pairs(*shared.value, batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), shape.dimension), settings.neighbours)

        found = materialize(spark, ranked(rows.mapInArrow(compared, PAIRS), settings), "compared-with-all")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
