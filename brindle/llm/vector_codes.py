"""Vector code compression: product codes over integer codebooks, exact in 64 bits.

A vector's components become integers, ``floor(scale * x)``, and it is cut into
equal parts.  Each part position has a codebook, and a part is coded as the
index of its nearest entry.  Codebooks start as the parts of the rows with the
smallest keys and are refined in rounds: every task assigns its rows' parts to
the broadcast entries and passes on one sum and count for each entry, which a
grouped shuffle merges; the driver divides them.

Distances come from the norm expansion ``|x|^2 - 2 x.c + |c|^2`` by products of
int64 matrices.  All sums stay below 2^62, which the bound on components sees
to, so they are exact and ties are ties.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize, scratch, settings_of, workers_import_this


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    #: Components (int64) that a task works on at once, about.
    cells: int = 1 << 18
    #: Bytes of an Arrow batch.
    batch_bytes: int = 4 << 20


#: Entries of a codebook at most: an index has two hexadecimal digits.
MOST_ENTRIES = 256


@dataclass(frozen=True)
class Coded:
    """``rows``: key, code, error, label_error; ``codebooks``: parts x entries x width; ``rounds``: summed error before each update."""

    rows: DataFrame
    codebooks: np.ndarray
    rounds: list[int]

    @property
    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def most_component(dimension: int) -> int:
    """The largest absolute integer component whose squared distances, over a whole vector, stay below 2^62."""
    return math.isqrt((1 << 60) // max(1, dimension))


def finite(vector: str) -> Column:
    """Not null, and all components numbers; of an empty vector this holds too."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def compress(spark: SparkSession, vectors: DataFrame, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> Coded:
    """Codes of all vectors, and the codebooks.

    Rows whose vector is null or holds a null or non-finite component are left
    out.  So are vectors of another length than most have (of equally frequent
    lengths, the longer counts); an empty vector has no parts.  That length must
    be a multiple of ``parts``, else a ValueError is raised, as it is for
    components too large for exact sums (see ``most_component``).  Of rows that
    share a key, that with the smallest integers starts an entry; null keys come
    last.  Fewer different keys than ``entries`` give as many entries.  Repeated
    rows are coded each for itself and weigh as often; null labels share a sum.
    Other columns are not read, whatever their names.  An empty table gives no
    rows and codebooks without entries.
    """
    if not 1 <= settings.entries <= MOST_ENTRIES:
        raise ValueError(f"a codebook has 1 to {MOST_ENTRIES} entries")
    workers_import_this(spark)
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * settings.scale).cast("double"))
    rows = vectors.where(finite(vector)).select(F.col(key).alias("k"), F.col(label).alias("label"), scaled.alias("v"))
    shapes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), F.desc("d"))
    shape = shapes.where("d > 0").first()
    if shape is None:
        return Coded(_outcome(spark, rows.limit(0).select("k", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), key), np.zeros((settings.parts, 0, 0), np.int64), [])
    if shape.d % settings.parts:
        raise ValueError(f"vectors of {shape.d} components can't be cut into {settings.parts} equal parts")
    if shape.most > most_component(shape.d):
        raise ValueError(f"a component of {shape.most:.0f} is beyond {most_component(shape.d)}: squared distances would not fit into 64 bits")
    rows = materialize(spark, rows.where(F.size("v") == shape.d).withColumn("v", F.col("v").cast("array<int>")), "integers")
    books = first_entries(rows, settings)
    ours = {"spark__sql__execution__arrow__maxBytesPerBatch": str(settings.batch_bytes)}
    errors = []
    with settings_of(spark, **ours):
        for _ in range(settings.rounds):
            books, error = refined(spark, rows, books, settings)
            errors.append(error)
        coded = materialize(spark, assigned(spark, rows, books, settings), "codes")
    return Coded(_outcome(spark, coded, key), books, errors)


def first_entries(rows: DataFrame, settings: Settings) -> np.ndarray:
    """The parts of the rows with the smallest keys: parts x entries x width.

    The driver gets at most ``entries`` keys and vectors at a time.
    """
    keys: list = []
    rest = rows.select("k")
    while len(keys) < settings.entries:
        # the smallest rows of each task, no shuffle; only keys that repeat make another pass necessary
        met = [r.k for r in rest.orderBy(F.col("k").asc_nulls_last()).limit(settings.entries).collect()]
        keys += [k for k in dict.fromkeys(met) if k not in keys]
        if len(met) < settings.entries or met[-1] is None:
            break
        rest = rest.where((F.col("k") > F.lit(met[-1])) | F.col("k").isNull())
    keys = keys[: settings.entries]
    known = [k for k in keys if k is not None]
    wanted = F.col("k").isin(known) if known else F.lit(False)
    wanted = F.coalesce(wanted, F.lit(None in keys))
    least = rows.where(wanted).groupBy("k").agg(F.min("v").alias("v")).orderBy(F.col("k").asc_nulls_last()).collect()
    found = np.array([r.v for r in least], np.int64)
    return np.ascontiguousarray(found.reshape(len(least), settings.parts, -1).transpose(1, 0, 2))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``x``, the first of the nearest entries, and its squared distance."""
    partial = (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)  # without |x|^2, which is alike for all entries
    index = partial.argmin(axis=1)
    return index, (x * x).sum(axis=1) + partial[np.arange(len(x)), index]


def _blocks(column: pa.Array, dimension: int, cells: int) -> Iterator[np.ndarray]:
    """The vectors of an Arrow column as int64 matrices of about ``cells`` components."""
    step = max(1, cells // dimension)
    for i in range(0, len(column), step):
        piece = column.slice(i, step)
        yield piece.flatten().to_numpy(zero_copy_only=False).reshape(len(piece), dimension).astype(np.int64)


def refined(spark: SparkSession, rows: DataFrame, books: np.ndarray, settings: Settings) -> tuple[np.ndarray, int]:
    """The codebooks after a round, and the squared distances, summed over all parts, before it.

    A task passes on its sums by entry and position, so the shuffle carries
    ``parts * entries * (width + 1)`` rows a task at most, however many vectors
    choose one entry.  An entry's count and the round's error are sums as well.
    """
    shared = spark.sparkContext.broadcast(books)
    dimension = books.shape[0] * books.shape[2]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, width = books.shape
        # the last position counts; the error needs more than one int64 and goes in two halves
        sums, error = np.zeros((parts, entries, width + 1), np.int64), 0
        for batch in batches:
            for x in _blocks(batch.column(0), dimension, settings.cells):
                for p in range(parts):
                    part = x[:, p * width : (p + 1) * width]
                    index, far = nearest(part, books[p])
                    order = np.argsort(index, kind="stable")
                    used, begin = np.unique(index[order], return_index=True)
                    sums[p, used, :width] += np.add.reduceat(part[order], begin, axis=0)
                    sums[p, used, width] += np.diff(np.append(begin, len(index)))
                    error += (int((far >> 31).sum()) << 31) + int((far & 0x7FFFFFFF).sum())
        p, e, i = np.nonzero(sums)
        columns = [np.append(p, [-1, -1]), np.append(e, [0, 0]), np.append(i, [0, 1]), np.append(sums[p, e, i], [error >> 40, error & ((1 << 40) - 1)])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["p", "e", "i", "s"])

    merged = rows.select("v").mapInArrow(summed, "p long, e long, i long, s long").groupBy("p", "e", "i").agg(F.sum("s").alias("s"))
    parts, entries, width = books.shape
    counts, sums, error = {}, {}, 0
    for r in merged.collect():  # parts * entries * (width + 1) rows at most, and two
        if r.p < 0:
            error += r.s << (0 if r.i else 40)
        elif r.i == width:
            counts[r.p, r.e] = r.s
        else:
            sums[r.p, r.e, r.i] = r.s
    after = books.copy()
    for (p, e), n in counts.items():
        after[p, e] = [sums.get((p, e, i), 0) // n for i in range(width)]
    shared.unpersist()
    return after, error


def assigned(spark: SparkSession, rows: DataFrame, books: np.ndarray, settings: Settings) -> DataFrame:
    """k, label, code and error of each row."""
    shared = spark.sparkContext.broadcast(books)
    dimension = books.shape[0] * books.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, _, width = books.shape
        digits = [f"{i:02x}" for i in range(MOST_ENTRIES)]
        for batch in batches:
            codes, errors = [], []
            for x in _blocks(batch.column(2), dimension, settings.cells):
                indexes, far = zip(*(nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)), strict=True)
                codes += ["".join(digits[i] for i in row) for row in np.stack(indexes, axis=1).tolist()]
                errors.append(sum(far))
            error = np.concatenate(errors) if errors else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["k", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("k", "label", "v").mapInArrow(coded, f"k {kinds['k']}, label {kinds['label']}, code string, error long")


def _outcome(spark: SparkSession, coded: DataFrame, key: str) -> DataFrame:
    """Adds the error summed over equal labels.

    The sums are made before rows are shuffled, and written, so that Spark
    knows their size: few labels are broadcast, very many are joined by label,
    where one with many rows can be split.
    """
    sums = materialize(spark, coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").select(F.col("k").alias(key), "code", "error", "label_error")


def write(coded: Coded, spark: SparkSession, root: str | None = None) -> str:
    """The codebooks beside the codes: ``root/codebooks`` (part, entry, components) and ``root/codes``."""
    root = root or scratch(spark, "vector-codes")
    books = [(p, e, row) for p, book in enumerate(coded.codebooks.tolist()) for e, row in enumerate(book)]
    spark.createDataFrame(books, "part int, entry int, components array<long>").coalesce(1).write.parquet(f"{root}/codebooks")
    coded.rows.write.parquet(f"{root}/codes")
    return root
