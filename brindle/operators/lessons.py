"""Reviewed notes ("lessons"): freshness, eligibility, and a copy-on-write table.

A lesson cites a scope and an evidence file with the digests both had.  It is
stale once either digest is no longer the live one; that is computed on read.

Freshness and eligibility are joins by scope and evidence, and a scope may have
very many lessons.  Over large tables texts don't belong into them: ``narrow``
takes from a lesson's text what is needed later, in the task that reads it.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LESSON

STATUSES = ("confirmed", "superseded", "disputed")


def scope_path(scope: str = "scope") -> Column:
    """The file of a symbol id ``path:name``."""
    return F.substring_index(F.col(scope), ":", 1)


def narrow(lessons: DataFrame, **needed: Column) -> DataFrame:
    """The lessons with, instead of their text, whether it is ``blank`` and the columns ``needed`` of it."""
    taken = [c.alias(n) for n, c in ({"blank": is_blank()} | needed).items()]
    return lessons.select(*[c for c in lessons.columns if c != "lesson"], *taken)


def is_blank() -> Column:
    return F.trim(F.coalesce("lesson", F.lit(""))) == ""


def with_freshness(lessons: DataFrame, hashes: DataFrame, path: Column | None = None) -> DataFrame:
    """Add ``stale``: a missing file, or another digest than the saved one."""
    live = hashes.select("path", "hash")
    evidence = live.select(F.col("path").alias("evidence"), F.col("hash").alias("_evidence"))
    scope = live.select(F.col("path").alias("_path"), F.col("hash").alias("_scope"))
    joined = lessons.withColumn("_path", path if path is not None else scope_path()).join(evidence, "evidence", "left").join(scope, "_path", "left")
    stale = F.coalesce((F.col("_evidence") != F.col("evidence_hash")) | (F.col("_scope") != F.col("scope_hash")), F.lit(True))
    return joined.withColumn("stale", stale).select(*lessons.columns, "stale")


def still_fresh(lessons: DataFrame, hashes: DataFrame) -> DataFrame:
    """Lessons with ``stale`` as it was read, also set where the captured digests are others; a null counts as stale."""
    live = with_freshness(lessons.drop("stale"), hashes).select("id", F.col("stale").alias("_live"))
    return lessons.join(live, "id").withColumn("stale", F.coalesce("stale", F.lit(True)) | F.col("_live")).drop("_live")


def eligible(lessons: DataFrame, symbols: DataFrame, hashes: DataFrame) -> DataFrame:
    """Confirmed lessons, said to be fresh and not blank, whose scope is a symbol and whose digests are those captured.

    Takes lessons with their texts or ``narrow`` ones.
    """
    blank = F.col("blank") if "blank" in lessons.columns else is_blank()
    known = symbols.select(F.col("id").alias("scope"), F.col("path").alias("_path"))
    live = hashes.select("path", "hash").where(F.col("hash").isNotNull())
    return (
        lessons.where((F.col("status") == "confirmed") & ~F.coalesce("stale", F.lit(True)) & F.col("id").isNotNull() & ~blank)
        .join(known, "scope")
        .join(live.select(F.col("path").alias("_path"), F.col("hash").alias("scope_hash")), ["_path", "scope_hash"], "left_semi")
        .join(live.select(F.col("path").alias("evidence"), F.col("hash").alias("evidence_hash")), ["evidence", "evidence_hash"], "left_semi")
        .select(*lessons.columns)
    )


def of_scopes(lessons: DataFrame | None, scopes: list[str]) -> list[dict]:
    """The lessons of a request's symbols, in order of id; the symbols bound them."""
    if lessons is None or not scopes:
        return []
    wanted = lessons.sparkSession.createDataFrame([(s,) for s in scopes], "scope string")
    return [r.asDict() for r in lessons.join(F.broadcast(wanted), "scope", "left_semi").orderBy("id").collect()]


def visible(rows: list[dict]) -> dict[str, list[dict]]:
    """Confirmed fresh lessons in full; of others only id, status and staleness."""
    out: dict[str, list[dict]] = {"lessons": [], "excluded_lessons": []}
    for r in rows:
        good = r["status"] == "confirmed" and not r["stale"]
        out["lessons" if good else "excluded_lessons"].append(r if good else {k: r[k] for k in ("id", "status", "stale")})
    return out


class LessonTable:
    """Lessons as versions of a Parquet table; a pointer file names the current one.

    One writer at a time, as many readers as like: a version is written whole
    before the pointer is renamed over the old one.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.fs = self._path("CURRENT").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _current(self) -> str | None:
        if not self.fs.exists(self._path("CURRENT")):
            return None
        stream = self.fs.open(self._path("CURRENT"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self) -> DataFrame:
        name = self._current()
        return self.spark.read.schema(LESSON).parquet(f"{self.root}/{name}") if name else self.spark.createDataFrame([], LESSON)

    def _publish(self, rows: DataFrame) -> None:
        if self.read_only:
            raise ValueError("the lesson table is read-only")
        name = f"v{dt.datetime.now(dt.UTC):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        draft = self._path(f".{name}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(name.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, self._path("CURRENT"), options)

    def add(self, symbols: DataFrame, hashes: DataFrame, scope: str, lesson: str, evidence: str) -> int:
        """Append a proposed lesson; the scope must be a symbol and the evidence an indexed file."""
        if self.read_only:
            raise ValueError("the lesson table is read-only")
        at = symbols.where(F.col("id") == scope).select("path").join(hashes, "path").select("hash").first()
        if at is None:
            raise ValueError("the scope must be an exact symbol id")
        if not lesson.strip():
            raise ValueError("the lesson is empty")
        if evidence.startswith("/") or ".." in evidence.split("/"):
            raise ValueError("the evidence must be a path inside the tree")
        proof = hashes.where((F.col("path") == evidence) & F.col("hash").isNotNull()).first()
        if proof is None:
            raise ValueError("the evidence must be an indexed file")
        now = self.read()
        number = (now.agg(F.max("id")).first()[0] or 0) + 1
        stamp = dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
        row = self.spark.createDataFrame([(number, scope, lesson, evidence, proof.hash, at.hash, "proposed", stamp)], LESSON)
        self._publish(now.unionByName(row))
        return number

    def set_status(self, number: int, status: str, hashes: DataFrame) -> None:
        """Change a lesson's status; only a fresh one may be confirmed."""
        if self.read_only:
            raise ValueError("the lesson table is read-only")
        if status not in STATUSES:
            raise ValueError(f"the status must be one of {', '.join(STATUSES)}")
        found = with_freshness(self.read().where(F.col("id") == number), hashes).first()
        if found is None:
            raise ValueError("unknown lesson")
        if status == "confirmed" and found.stale:
            raise ValueError("what the lesson cites has changed; add a new one")
        self._publish(self.read().withColumn("status", F.when(F.col("id") == number, F.lit(status)).otherwise(F.col("status"))))

    def list(self, hashes: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
        """Lessons with ``stale``, all or those of the given scopes (``id``), in order of their ids."""
        rows = self.read()
        if scopes is not None:
            rows = rows.join(scopes.select(F.col("id").alias("scope")), "scope", "left_semi").select(*rows.columns)
        return with_freshness(rows, hashes).orderBy("id")
