"""A snapshot of a source tree as tables: sources, symbols, edges, hashes, warnings."""

from __future__ import annotations

import json
import platform
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.python_units import unit
from ..functions.text import casefold, folded
from ..functions.web_units import SUFFIXES, web_unit
from ..operators import cache, diff, linking, ranking
from ..schemas import UNIT
from ..sources.tree import capture, rejection
from ..storage import stage, workers_import_this

#: Units from another parser are not reused.
PARSER = f"python:1:{platform.python_version()};web:1"
STORED = "path string, digest string, parser string, payload string, checksum string"


def parse(files: DataFrame) -> DataFrame:
    """Rows of ``schemas.UNIT`` for source files (path, content)."""
    workers_import_this(files.sparkSession)
    arrow = to_arrow_schema(UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(unit if p.endswith(".py") else web_unit)(p, c or b"") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for r in rows:
                r["aliases"] = list(r["aliases"].items())
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, UNIT)


@dataclass
class Snapshot:
    """Frames are staged: a request sees one capture however often it reads it."""

    spark: SparkSession
    sources: DataFrame
    symbols: DataFrame
    edges: DataFrame
    hashes: DataFrame
    warnings: list[str] = field(default_factory=list)
    indexing: dict = field(default_factory=dict)

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, units_at: str | None = None) -> Snapshot:
        return cls.of_files(spark, capture(spark, root), units_at)

    @classmethod
    def of_files(cls, spark: SparkSession, files: DataFrame, units_at: str | None = None, web: bool = True) -> Snapshot:
        """From rows (path, content, warning?); with ``units_at``, units stored there are reused.

        A store that can't be read or written is no error: all files are parsed
        and a warning says so.  Without ``web``, files of TypeScript and
        JavaScript are kept but not looked into, and a warning names them.
        """
        if "warning" not in files.columns:
            files = files.withColumn("warning", F.lit(None).cast("string"))
        judged = stage(files.withColumn("rejected", F.when(F.col("content").isNotNull(), rejection())), "judged")
        warnings = [r.warning for r in judged.where("warning IS NOT NULL").orderBy("path").select("warning").collect()]
        warnings += [r.rejected for r in judged.where("rejected IS NOT NULL").orderBy("path").select("rejected").collect()]
        sources = stage(judged.where("content IS NOT NULL AND rejected IS NULL").select("path", "content", F.sha2("content", 256).alias("hash")), "sources")
        python = F.col("path").endswith(".py")
        units, indexing, problem = cls._units(spark, sources if web else sources.where(python), units_at)
        warnings += [w for r in units.where(F.size("warnings") > 0).orderBy(~python, "path").select("warnings").collect() for w in r.warnings]
        if not web and (left := [r.path for r in sources.where(~python).select("path").orderBy("path").collect()]):
            warnings.append("TypeScript/JavaScript parsing unavailable; it is switched off. Unindexed files: " + ", ".join(left))
        if problem:
            warnings.append(problem)
        good = units.where("hash IS NOT NULL")
        symbols = stage(good.select(F.inline("symbols")).withColumn("folded", F.array(folded("id"), folded("name"))), "symbols")
        modules = linking.last_wins(good.select("module", "path", "aliases"), "module", "path", "aliases")
        aliases = modules.select("module", F.explode("aliases").alias("name", "target"))
        edges, missed = cls._linked(good, symbols, aliases)
        warnings += [f"Unresolved calls ({r.unresolved}) in {r.symbol}; dynamic/type/JSX dispatch is not modeled" for r in missed.orderBy("symbol").collect()]
        return cls(spark, sources, symbols, edges, stage(good.select("path", "hash"), "hashes"), warnings, indexing)

    @staticmethod
    def _linked(good: DataFrame, symbols: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges of all languages, and web-language symbols with their number of unresolved calls."""
        edges = linking.link(good.select(F.inline("calls")), symbols, aliases)
        web = stage(good.where("web IS NOT NULL").select("path", "web.*"), "web-units")
        if web.isEmpty():
            return stage(edges, "edges"), web.sparkSession.createDataFrame([], "symbol string, unresolved long")
        modules = linking.resolve_modules(web.select("path", F.inline("imports")), web.select("path"), list(SUFFIXES))
        unsafe = web.select("path", F.explode("unsafe").alias("name"))
        more, missed = linking.link_web(web.select(F.inline("calls")), symbols, modules, web.select("path", F.inline("exports")), unsafe)
        return stage(edges.union(more), "edges"), stage(missed, "unresolved")

    @staticmethod
    def _units(spark: SparkSession, files: DataFrame, at: str | None) -> tuple[DataFrame, dict, str | None]:
        if at is None:
            return stage(parse(files), "units"), {}, None
        problem, stored = None, spark.createDataFrame([], STORED)
        try:
            stored = _pointer(spark, at) or stored
        except Exception as e:
            problem = f"The store of units can't be read ({type(e).__name__}); all files were parsed."
        kept = cache.usable(stored, files, PARSER)
        reused = kept.select(F.from_json("payload", UNIT).alias("u")).select("u.*").where("path IS NOT NULL")
        fresh = parse(cache.misses(files, reused))
        units = stage(reused.unionByName(fresh), "units")
        counts = cache.counters(stored.join(kept.select("path"), "path", "left_semi").select("path", F.col("digest").alias("hash")).unionByName(stored.join(files.select("path"), "path", "left_anti").select("path", F.col("digest").alias("hash"))), files.select("path", "hash")).first()
        if not problem and (counts.parsed or counts.removed):
            try:
                payload = units.withColumn("payload", F.to_json(F.struct(*UNIT.names))).join(files.select("path", F.col("hash").alias("digest")), "path")
                _publish(spark, at, payload.select("path", "digest", F.lit(PARSER).alias("parser"), "payload", F.sha2("payload", 256).alias("checksum")))
            except Exception as e:
                problem = f"The store of units can't be written ({type(e).__name__}); the evidence is fresh."
        return units, {"captured_files": counts.captured, "reused_files": counts.reused, "parsed_files": counts.parsed, "removed_files": counts.removed, "cache": "fallback" if problem else "persistent"}, problem

    def fields(self) -> dict:
        return {"name": F.col("name"), "path": F.col("path"), "body": F.col("source")}

    def lexical(self, query: str) -> DataFrame:
        """Rows of BM25 over names, paths and bodies; a query that is a name or an id is exact."""
        wanted = casefold(query)
        exact = F.array_contains("folded", wanted) if wanted else None
        return ranking.lexical(self.symbols, query, self.fields(), exact=exact)

    def select(self, name: str) -> str:
        """The id that a name or an id means; ``ValueError`` if none or several."""
        if not self.symbols.where(F.col("id") == name).isEmpty():
            return name
        found = [r.id for r in self.symbols.where(F.col("name") == name).select("id").orderBy("id").limit(21).collect()]
        if len(found) == 1:
            return found[0]
        raise ValueError(f"Ambiguous symbol {name!r}; use one of: {', '.join(found)}" if found else f"Unknown symbol: {name}")

    def identity(self) -> str:
        return diff.fingerprint(self.sources).first().fingerprint

    def describe(self) -> dict:
        """Everything but the bytes; for trees that fit a report."""
        return {
            "files": self.hashes.count(), "symbols": [r.asDict() for r in self.symbols.drop("folded").orderBy("id").collect()],
            "edges": [{"from": r.src, "to": r.dst, "kind": "calls"} for r in self.edges.orderBy("src", "dst").collect()],
            "warnings": self.warnings, "file_hashes": dict(self.hashes.select("path", "hash").collect()), **({"indexing": self.indexing} if self.indexing else {}),
        }


def _store(spark: SparkSession, at: str, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/{name}")
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _pointer(spark: SparkSession, at: str) -> DataFrame | None:
    """The current generation of stored units."""
    path, fs = _store(spark, at, "CURRENT")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        current = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return spark.read.schema(STORED).parquet(f"{at.rstrip('/')}/{current['generation']}")


def _publish(spark: SparkSession, at: str, rows: DataFrame) -> None:
    """Write a whole generation, then move the pointer: readers see the old or the new one."""
    import uuid

    name = f"g-{uuid.uuid4().hex}"
    rows.write.parquet(f"{at.rstrip('/')}/{name}")
    draft, fs = _store(spark, at, f".{name}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"generation": name}).encode()))
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(draft, _store(spark, at, "CURRENT")[0], options)
