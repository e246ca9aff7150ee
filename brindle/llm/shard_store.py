"""A store of immutable shards under versioned manifests, compacted by size tiers.

Arrivals are appended as small Parquet shards.  Shards of similar size (a tier
spans a factor of ``fanout``) are merged into files of about a target size: a
round reads all shards of a tier in one job and writes one file per task, without
a shuffle.  Every change is a new manifest, committed by renaming a complete
file to the next version's name, which fails if that version exists; a writer
that loses reads the latest version and commits again.

A reader opens one manifest and sees exactly its shards.  Compaction deletes
nothing: a version stays readable until ``sweep`` drops it, which also removes
what failed jobs left.  DataFrame and SQL functions only; the driver lists, names
and renames files through Spark's own file systems, and holds one manifest (some
100 bytes a shard, so 80 MB for 100 TB in files of the target size).
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import named, normalised_schema


class CommitConflict(RuntimeError):
    """Another writer committed this version first; read the latest and try again."""


@dataclass(frozen=True)
class Settings:
    #: Rows of an arriving shard, at most.
    arrival_rows: int = 2_000
    #: Bytes that merged shards aim at.
    target: int = 128 << 20
    #: Shards at this part of the target are left alone.
    full: float = 0.75
    #: Shards of a tier that are merged at least, and the factor between tiers.
    fanout: int = 4
    #: Bytes of the lowest tier's upper edge.
    lowest: int = 1 << 20
    codec: str = "zstd"
    #: Times that a commit is tried again after another writer's.
    retries: int = 20


@dataclass(frozen=True)
class Shard:
    path: str  #: relative to the store
    bytes: int
    rows: int
    tier: int


@dataclass(frozen=True)
class Manifest:
    version: int
    shards: tuple[Shard, ...]
    schema: str | None = None


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings
        self.jvm = spark._jvm
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.fs.mkdirs(self._path("manifests"))

    def _path(self, relative: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}" if relative else self.root)

    # manifests

    def versions(self) -> list[int]:
        names = (f.getPath().getName() for f in self.fs.listStatus(self._path("manifests")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, or the latest; version 0 is empty and has no file."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, ())
        stream = self.fs.open(self._path(f"manifests/v{version:010d}.json"))
        try:
            found = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(found["version"], tuple(Shard(**s) for s in found["shards"]), found["schema"])

    def commit(self, before: Manifest, shards: list[Shard], schema: str | None) -> Manifest:
        """Make ``shards`` the version after ``before``, or raise ``CommitConflict``."""
        after = Manifest(before.version + 1, tuple(sorted(shards, key=lambda s: s.path)), schema)
        final = self._path(f"manifests/v{after.version:010d}.json")
        draft = self._path(f"manifests/.{uuid.uuid4().hex}.draft")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": after.version, "schema": schema, "shards": [asdict(s) for s in after.shards]}).encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, options)  # without OVERWRITE: fails if it exists
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise CommitConflict(f"version {after.version} exists") from e
            raise
        return after

    # data

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.settings.lowest, self.settings.fanout)) + 1) if size >= self.settings.lowest else 0

    def _write(self, df: DataFrame, rows: int | None = None) -> list[Shard]:
        """Write a fresh folder of shards; no manifest has them yet."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", self.settings.codec)
        (writer.option("maxRecordsPerFile", rows) if rows else writer).parquet(f"{self.root}/{folder}")
        files = [(f.getPath().getName(), f.getLen()) for f in self.fs.listStatus(self._path(folder)) if f.getPath().getName().startswith("part-")]
        back = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")
        counted = back.select(back.metadataColumn("_metadata")["file_name"].alias("name")).groupBy("name").count()
        n = dict(counted.collect())  # a row per file just written, from the footers
        return [Shard(f"{folder}/{name}", size, n.get(name, 0), self.tier(size)) for name, size in files if n.get(name, 0)]

    def append(self, df: DataFrame) -> Manifest:
        """Add a frame's rows as small shards, in one commit.

        All appended frames must have the first one's schema (nullability
        aside).  An empty frame commits a version with no new shard.  Others may
        append at the same time: the shards are written once, the commit is
        tried again.
        """
        schema = normalised_schema(df.schema).json()
        made = None
        for _ in range(self.settings.retries + 1):
            before = self.manifest()
            if before.schema not in (None, schema):
                raise ValueError("the schema differs from the store's")
            made = self._write(df, self.settings.arrival_rows) if made is None else made
            try:
                return self.commit(before, [*before.shards, *made], schema)
            except CommitConflict:
                continue
        raise CommitConflict("other writers were first each time")

    def runs(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """What to merge now: the tiers with ``fanout`` shards or more that are below their full size."""
        by_tier: dict[int, list[Shard]] = {}
        for shard in shards:
            if shard.bytes < self.settings.target * self.settings.full:
                by_tier.setdefault(shard.tier, []).append(shard)
        return [sorted(own, key=lambda x: (x.bytes, x.path)) for _, own in sorted(by_tier.items()) if len(own) >= max(2, self.settings.fanout)]

    def merged(self, run: list[Shard], schema: T.StructType) -> list[Shard]:
        """A tier's shards as files of about the target size: one job, a task per file.

        Shards of a tier are alike in size, so tasks that take the same number
        of them write alike files.
        """
        files = math.ceil(sum(x.bytes for x in run) / self.settings.target)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{x.path}" for x in run])
        return self._write(rows.coalesce(files))

    def compact(self) -> Manifest:
        """Merge until no tier has a run; a commit per round.

        The inputs stay for the readers of earlier versions (see ``sweep``).  If
        another writer commits during a round, the round's result is committed on
        top of that, unless the other took away one of its inputs.  An empty
        store stays as it is.
        """
        now = self.manifest()
        while runs := self.runs(now.shards):
            schema = T.StructType.fromJson(json.loads(now.schema))
            made = [s for run in runs for s in self.merged(run, schema)]
            gone = {s.path for run in runs for s in run}
            if sum(s.rows for s in made) != sum(s.rows for run in runs for s in run):
                raise RuntimeError("a merge lost rows; nothing was committed")
            if len(made) >= len(gone):
                return now  # files can't become fewer; what was written is swept later
            for _ in range(self.settings.retries + 1):
                if not gone <= {s.path for s in now.shards}:
                    break  # another compaction was first: begin anew from its result
                try:
                    now = self.commit(now, [*(s for s in now.shards if s.path not in gone), *made], now.schema)
                    break
                except CommitConflict:
                    now = self.manifest()
            else:
                raise CommitConflict("other writers were first each time")
        return now

    def sweep(self, keep: int = 2, older_than: float = 3600.0) -> int:
        """Delete all but the ``keep`` latest versions, and every data file that these don't name; return how many files.

        Files younger than ``older_than`` seconds stay, as a writer may be about
        to commit them; readers of dropped versions fail.
        """
        versions = self.versions()
        for version in versions[:-keep]:
            self.fs.delete(self._path(f"manifests/v{version:010d}.json"), False)
        held = {s.path for version in versions[-keep:] for s in self.manifest(version).shards}
        before, gone = (time.time() - older_than) * 1000, 0
        if not self.fs.exists(self._path("data")):
            return 0
        for folder in self.fs.listStatus(self._path("data")):
            left = 0
            for f in self.fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{f.getPath().getName()}"
                if name not in held and f.getModificationTime() <= before:
                    self.fs.delete(f.getPath(), True)
                    gone += f.getPath().getName().startswith("part-")
                else:
                    left += 1
            if not left and folder.getModificationTime() <= before:
                self.fs.delete(folder.getPath(), True)
        return gone

    def read(self, version: int | None = None, shard: str = "_shard") -> DataFrame:
        """The rows of a version, with the name of their file under the name ``shard``.

        Columns may have any other names.  A version without shards, or version
        0, has no rows.
        """
        found = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(found.schema)) if found.schema else T.StructType()
        if shard in schema.names:
            raise ValueError(f"the table has a column {shard!r}; give another name for the shard's")
        if not found.shards:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(shard, T.StringType())]))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in found.shards])
        return rows.select("*", rows.metadataColumn("_metadata")["file_name"].alias(shard))


def compacted(spark: SparkSession, docs: DataFrame, root: str, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Append ``docs`` to a store, compact it, and read it back.

    Per row: key, ``columns``, text_sha256 of the stored text (null for a null
    text), and ``listed``: whether the row's file is in the last manifest with
    as many rows as are read from it.  Equal rows are stored each for itself;
    every column is stored, whatever its name; an empty table gives an empty
    result.
    """
    store = ShardStore(spark, root, settings)
    store.append(docs)
    final = store.compact()
    store.sweep(1, 0.0)  # nobody else has this store
    name = "_shard"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    rows = store.read(final.version, name)
    # a row per shard: the manifest itself, and what is counted from the files
    shards = spark.createDataFrame([(s.path.rsplit("/", 1)[1], s.rows) for s in final.shards], "_file string, _rows long")
    counted = rows.groupBy(name).agg(F.count("*").alias("_read"))
    known = shards.join(counted, F.col("_file") == F.col(name)).select("_file", (F.col("_rows") == F.col("_read")).alias("listed"))
    found = rows.select(*named([key, *columns]), F.col(name).alias("_file"), F.sha2(*named([text]), 256).alias("text_sha256"))
    return found.join(F.broadcast(known), "_file", "left").select(*named([key, *columns]), "text_sha256", F.coalesce("listed", F.lit(False)).alias("listed"))
