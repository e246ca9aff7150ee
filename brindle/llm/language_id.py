"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character n-grams.  Each
language has several centroids, found by spherical k-means over a bounded
sample of labelled texts.  A text gets the language of the most similar
centroid; it is rejected if that similarity is far below what the language's
own sample has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import held, named, workers_import_this

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    #: Labelled texts per language that the model is fitted on, at most.
    sample: int = 400
    centroids: int = 4
    iterations: int = 12
    #: Hashed n-grams; a power of two.
    dimensions: int = 1 << 13
    orders: int = 3
    #: A text is rejected below this part of the lowest similarity in the sample.
    reject: float = 0.25


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    idf: np.ndarray
    #: One row per centroid; ``owner`` has the index of its language.
    centroids: np.ndarray
    owner: np.ndarray
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, similarity (0 to 1) and whether the text is rejected."""
        counts = ngram_counts(text, self.settings)
        if counts is None:
            return UNDETERMINED, 0.0, True
        if not self.languages:
            return UNDETERMINED, 0.0, False
        index, n = counts
        near = self.centroids[:, index] @ weighted(index, n, self.idf)
        at = int(np.argmax(near))
        score = float(min(max(near[at], 0.0), 1.0))
        return self.languages[self.owner[at]], score, score < self.threshold[self.owner[at]]


def _letters() -> np.ndarray:
    return held(("letters",), lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def ngram_counts(text: str | None, settings: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a whole text and how often each occurs; None if it has no letter.

    Letters are lower-cased; everything else counts as a space.
    """
    if not text:
        return None
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    known = _letters()[codes]
    if not known.any():
        return None
    codes = np.where(known, codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    shift = np.uint32(32 - settings.dimensions.bit_length() + 1)
    gram, hashed = np.zeros(len(codes), np.uint32), []
    for order in range(settings.orders):
        gram = gram[: len(codes) - order] * np.uint32(0x9E3779B1) + codes[order:] + np.uint32(1)
        hashed.append((gram * np.uint32(0x85EBCA6B)) >> shift)
    n = np.bincount(np.concatenate(hashed), minlength=settings.dimensions)
    index = np.flatnonzero(n)
    return index.astype(np.int32), n[index].astype(np.int32)


def weighted(index: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vector = (1 + np.log(n)) * idf[index]
    return vector / (np.linalg.norm(vector) or 1.0)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on at most ``settings.sample`` labelled texts of each language that is a label.

    The texts with the least hash of key and text are taken, equal ones once;
    held-out rows, null keys, null labels and texts without a letter are not.
    What comes to the driver grows with the number of languages, not of texts,
    their length or how often a key repeats.
    """
    workers_import_this(spark)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("id"), F.col(lang).alias("label"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    sizes = labelled.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))  # a row per language
    place = F.col("h").bitwiseAND(0xFFFFFFFF) / float(1 << 32)
    # a first cut by the hash, at twice the bound, so that no task ranks more than it must
    near = labelled.join(F.broadcast(sizes), "label").withColumn("place", place).where(F.col("place") * F.col("n") < 2.0 * settings.sample)
    order = Window.partitionBy("label").orderBy("place", "id", "h")
    chosen = near.select("id", "label", "h", "place").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= settings.sample).select("id", "label", "h")
    # at most sample x languages rows are asked for, and equal rows come once
    texts = labelled.join(F.broadcast(chosen), ["id", "label", "h"]).dropDuplicates(["id", "label", "h"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), label.as_py(), c) for i, label, t in zip(*batch.columns, strict=True) if (c := ngram_counts(t.as_py(), settings))]
            yield pa.RecordBatch.from_arrays([pa.array([str(r[0]) for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2][0].tobytes() for r in rows], pa.binary()), pa.array([r[2][1].tobytes() for r in rows], pa.binary())], ["id", "label", "grams", "n"])

    rows = texts.select("id", "label", "text").mapInArrow(counted, "id string, label string, grams binary, n binary").collect()
    return fitted(sorted((r.label, r.id, bytes(r.grams), bytes(r.n)) for r in rows), settings)


def fitted(rows: list[tuple[str, str, bytes, bytes]], settings: Settings) -> Model:
    sparse = [(label, np.frombuffer(g, np.int32), np.frombuffer(n, np.int32)) for label, _, g, n in rows]
    df = np.zeros(settings.dimensions)
    for _, index, _ in sparse:
        df[index] += 1
    idf = np.log((1 + len(sparse)) / (1 + df)) + 1
    per_language: dict[str, list] = {}
    for label, index, n in sparse:
        per_language.setdefault(label, []).append((index, n))
    languages = sorted(per_language)
    centroids, owner, lowest = [], [], []
    for k, language in enumerate(languages):
        own = per_language[language]
        x = np.zeros((len(own), settings.dimensions), np.float32)
        for row, (index, n) in enumerate(own):
            x[row, index] = weighted(index, n, idf)
        c = spherical_kmeans(x, min(settings.centroids, len(own)), settings.iterations)
        centroids.append(c)
        owner += [k] * len(c)
        lowest.append(float((x @ c.T).max(axis=1).min()))
    stacked = np.concatenate(centroids).astype(np.float64) if centroids else np.zeros((0, settings.dimensions))
    return Model(settings, languages, idf, stacked, np.array(owner, int), settings.reject * np.array(lowest))


def spherical_kmeans(x: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Unit centroids; starts from rows far from each other, the first in order."""
    c = [x.mean(axis=0)]
    far = x @ (c[0] / (np.linalg.norm(c[0]) or 1.0))
    c = [x[int(np.argmax(far))]]
    near = x @ c[0]
    while len(c) < k:
        c.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ c[-1])
    centers = np.stack(c)
    for _ in range(iterations):
        member = (x @ centers.T).argmax(axis=1)
        for j in range(k):
            own = x[member == j]
            if len(own):
                mean = own.mean(axis=0)
                centers[j] = mean / (np.linalg.norm(mean) or 1.0)
    return centers


def judgement(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """Struct<lang, score, rejected> of a text column.

    Only the text goes to Python; what else a row has stays in the JVM.  A text
    that is null or has no letter gets ``und``, 0 and true.  Without any
    labelled text the model knows no language and every text gets ``und``,
    unrejected if it has letters.
    """
    workers_import_this(spark)
    shared = spark.sparkContext.broadcast(model)  # grows with the languages; centroids and dimensions are fixed

    def judged(texts: pa.Array) -> pa.Array:
        rows = [shared.value.judge(t.as_py()) for t in texts]
        parts = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([bool(r[2]) for r in rows], pa.bool_())]
        return pa.StructArray.from_arrays(parts, ["lang", "score", "rejected"])

    return F.arrow_udf(judged, "struct<lang:string,score:double,rejected:boolean>")(*named([text]))


def identify(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on ``docs`` and judge each of its rows: doc_id, held_out, lang_pred, score, rejected.

    Rows are independent: repeated rows repeat, an empty table gives an empty
    one, a null doc_id is never held out.  See ``fit`` and ``judgement``.
    """
    model = fit(spark, docs, settings)
    judged = docs.select("doc_id", held_out().alias("held_out"), judgement(spark, model).alias("j"))
    return judged.select("doc_id", "held_out", F.col("j.lang").alias("lang_pred"), "j.score", "j.rejected")


def keep_identified(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows, with all their columns, whose text is not rejected.

    Texts that are null or have no letter go; repeated rows are judged each for
    itself; an empty table, or one without labels, loses no text with letters.
    """
    model = fit(spark, docs, settings)
    return docs.where(~judgement(spark, model).getField("rejected"))
