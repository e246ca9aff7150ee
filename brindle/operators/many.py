"""BM25 for many queries at once: the best texts of each.

The texts are read once: what is kept of each is how often the queries' terms
stand in it, and its length.  Statistics of the corpus and all scores come from
that narrow table.  Queries go over it in blocks of a stated size; a task keeps
the best of each query for its own texts and passes on no more than these, so
pairs of queries and texts are never shuffled.  Contributions are added in the
terms' order, as ``ranking`` adds them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tokenizer import Wanted, distinct_tokens, lists
from ..storage import ordinal, stage, workers_import_this
from .ranking import K1, B

#: Blocks of queries whose terms are counted in one pass over the texts.
BLOCKS = 16
#: Texts that are scored at once.
CHUNK = 512


def term_counts(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """The rows with, instead of ``text``, its number of terms and, for each of ``terms`` in it, the place in the list and the count."""
    spark = docs.sparkSession
    workers_import_this(spark)
    kept = [f for f in docs.schema.fields if f.name != text]
    shared = spark.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(shared.value)
        for batch in batches:
            found = [wanted.count(t.as_py()) for t in batch.column(text)]
            added = [pa.array([n for n, _ in found], pa.int64()), lists((met for _, met in found), pa.int32()), lists((met.values() for _, met in found), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *added], [*(f.name for f in kept), "length", "terms", "tf"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "length bigint, terms array<int>, tf array<int>"])
    return stage(docs.mapInArrow(counted, schema), "term-counts")


class _Queries:
    """The terms of a block of queries: for each, in order, its weight and the queries that have it."""

    def __init__(self, rows: list[Row], n: int, mean: float):
        self.keys = sorted({r.query for r in rows})
        at = {k: i for i, k in enumerate(self.keys)}
        by_term: dict[int, tuple[int, list[int]]] = {}
        for r in rows:
            by_term.setdefault(r.place, (r.df, []))[1].append(at[r.query])
        places = sorted(by_term)  # places are in the terms' order
        self.weights = [math.log(1 + (n - by_term[p][0] + 0.5) / (by_term[p][0] + 0.5)) for p in places]
        self.queries = [np.array(sorted(by_term[p][1])) for p in places]
        self.own = np.full(places[-1] + 2, -1)
        self.own[places] = np.arange(len(places))
        self.mean = mean

    def scores(self, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """texts x queries, from the texts' lengths, and their terms and counts with the ends of each text's."""
        out = np.zeros((len(lengths), len(self.keys)))
        norms = K1 * (1 - B + B * lengths / self.mean) if self.mean > 0 else np.full(len(lengths), K1)
        at = np.repeat(np.arange(len(lengths)), np.diff(ends, prepend=0))
        own = self.own[np.minimum(terms, len(self.own) - 1)]  # the last is -1: terms of other blocks
        met = np.flatnonzero(own >= 0)
        met = met[np.argsort(own[met], kind="stable")]
        own, at, tf = own[met], at[met], tf[met].astype(np.float64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        for lo, hi in zip(first, [*first[1:], len(own)], strict=True):
            f, rows = tf[lo:hi], at[lo:hi]
            out[np.ix_(rows, self.queries[own[lo]])] += (self.weights[own[lo]] * f * (K1 + 1) / (f + norms[rows]))[:, None]
        return out


def best(docs: DataFrame, queries: DataFrame, limit: int, block: int = 128, keep: tuple[str, ...] = (), key: str = "id", text: str = "text") -> DataFrame:
    """For each query (query, text), its best texts: query, pos (from 1), key, score and the columns ``keep``.

    The order is by score, then key.  Only texts with a common term are found;
    null keys are left out, though their texts count; queries of one id are one
    query with all their terms; queries without terms have no rows.  The texts
    are read once for each ``BLOCKS`` times ``block`` queries.
    """
    if type(limit) is not int or limit < 1 or block < 1:
        raise ValueError("the limit and the block must be positive")
    spark = docs.sparkSession
    workers_import_this(spark)
    terms = stage(queries.where(F.col("query").isNotNull()).select("query", F.explode(distinct_tokens(F.col("text"))).alias("term")).distinct(), "query-terms")
    numbered = stage(ordinal(terms.select("query").distinct(), "nth", "query").select("query", F.floor(F.col("nth") / block).alias("block")), "query-blocks")
    blocks = int(numbered.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0])
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *keep)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join(["query " + terms.schema["query"].dataType.simpleString(), "score double", "key " + kinds["key"], *(f"`{c}` {kinds[c]}" for c in keep)])
    placed = terms.join(numbered, "query")
    found = None
    for begin in range(0, blocks, BLOCKS):
        own = placed.where(F.col("block").between(begin, begin + BLOCKS - 1))
        listed = sorted(r.term for r in own.select("term").distinct().collect())  # the terms of BLOCKS blocks
        counted = term_counts(slim, listed)
        whole = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("terms")).first()
        df = {r.place: r.df for r in counted.select(F.explode("terms").alias("place")).groupBy("place").agg(F.count("*").alias("df")).collect()}  # a row per listed term
        place = {t: i for i, t in enumerate(listed)}
        for number in range(begin, min(begin + BLOCKS, blocks)):
            rows = own.where(F.col("block") == number).select("query", "term").collect()  # the terms of ``block`` queries
            rows = [Row(query=r["query"], place=p, df=df[p]) for r in rows if (p := place[r.term]) in df]  # a term that no text has adds nothing
            if not rows:
                continue
            block_of = spark.sparkContext.broadcast(_Queries(rows, whole.n, whole.terms / whole.n))
            narrow = counted.where("key IS NOT NULL").select("key", "length", "terms", "tf", *keep)
            part = stage(narrow.mapInArrow(_scorer(block_of, limit, keep, to_arrow_type(terms.schema["query"].dataType)), schema), "best-of-tasks")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key", *keep)
    return found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("query", "pos", F.col("key").alias(key), "score", *keep)


def _scorer(shared: Broadcast, limit: int, keep: tuple[str, ...], query_type: pa.DataType):
    """The best of each query among a task's texts; what a task passes on is bounded by the block and the limit."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Queries = shared.value
        tops: list[list[tuple]] = [[] for _ in own.keys]
        floor = np.zeros(len(own.keys))
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(0).type, *(batch.column(4 + i).type for i in range(len(keep)))]
            for at in range(0, len(batch), CHUNK):
                piece = batch.slice(at, CHUNK)
                ends = np.cumsum(piece.column(2).value_lengths().to_numpy())
                scores = own.scores(piece.column(1).to_numpy(), ends, piece.column(2).flatten().to_numpy(), piece.column(3).flatten().to_numpy())
                keys = piece.column(0).to_pylist()
                kept = list(zip(*(piece.column(4 + i).to_pylist() for i in range(len(keep))), strict=True)) or [()] * len(keys)
                good = (scores > 0) & (scores >= floor[None, :])
                for q in np.flatnonzero(good.any(axis=0)):
                    more = [(-scores[i, q], keys[i], kept[i]) for i in np.flatnonzero(good[:, q])]
                    tops[q] = heapq.nsmallest(limit, tops[q] + more, key=_order)
                    if len(tops[q]) == limit:
                        floor[q] = -tops[q][-1][0]
        rows = [(own.keys[q], *entry) for q, top in enumerate(tops) for entry in top]
        if rows:
            columns = [pa.array([r[0] for r in rows], query_type), pa.array([-r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], types[0])]
            columns += [pa.array([r[3][i] for r in rows], types[1 + i]) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "score", "key", *keep])

    return scored


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], [(x is not None, x) for x in entry[2]]
