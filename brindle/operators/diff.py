"""Two snapshots: status of paths, changed lines, and the records they touch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.line_match import changed_blocks
from ..storage import workers_import_this


def status(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per path of two snapshots (path, hash): added, deleted, modified or unchanged."""
    a, b = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full").select("path", kind.alias("status"), "old_hash", "new_hash")


def line_diff(changed: DataFrame) -> DataFrame:
    """Hunks (path, seq, kind, old and new start and count) of rows (path, old, new) of bytes.

    Lines are those of ``bytes.splitlines``; starts count from 1; a null side
    has no lines.  No SQL function finds matching blocks, so paths are compared
    by Python workers, each on its own.
    """
    workers_import_this(changed.sparkSession)
    names = ["path", "seq", "kind", "old_start", "old_count", "new_start", "new_count"]
    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, old, new in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(path, *h) for h in hunks(old, new)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    slim = changed.select("path", F.col("old").cast("binary"), F.col("new").cast("binary"))
    return slim.mapInArrow(compare, "path string, seq int, kind string, old_start int, old_count int, new_start int, new_count int")


def hunks(old: bytes | None, new: bytes | None) -> list[tuple]:
    changed = changed_blocks((old or b"").splitlines(), (new or b"").splitlines())
    return [(n, kind, a + 1, b - a, c + 1, d - c) for n, (kind, a, b, c, d) in enumerate(changed)]


def touched(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pairs of changed ranges (path, start, end: lines start+1 to end) and the symbols they overlap.

    An equi-join on the path with the range as a residual condition.
    """
    s = symbols.select("path", F.col("id").alias("symbol"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return ranges.join(s, "path").where((F.col("start") < F.col("s_end")) & (F.col("end") >= F.col("s_start")) & (F.col("start") < F.col("end"))).drop("s_start", "s_end")


def uncovered(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line): changed lines inside no symbol of the path."""
    lines = ranges.where("start < end").select("path", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("line")).distinct()
    s = symbols.select(F.col("path").alias("s_path"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    inside = (F.col("path") == F.col("s_path")) & F.col("line").between(F.col("s_start"), F.col("s_end"))
    return lines.join(s, inside, "left_anti")


def seeds(ranges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (id) and the paths that fell back on all their symbols because a changed line is outside them."""
    outside = uncovered(ranges, symbols).select("path").distinct()
    fallback = symbols.join(outside, "path", "left_semi").select("id")
    return touched(ranges, symbols).select(F.col("symbol").alias("id")).unionByName(fallback).distinct(), outside


def surviving(old_seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    return old_seeds.join(symbols.select("id"), "id", "left_semi")


def removed(old_seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    return old_seeds.join(symbols.select("id"), "id", "left_anti")


def recovered_callers(old_edges: DataFrame, old_seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """Callers, in the old graph, of old seeds, as far as they still exist."""
    callers = old_edges.join(old_seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return callers.join(symbols.select("id"), "id", "left_semi")


def changed_kind(letter: Column) -> Column:
    """The name of a one-letter status; others stay."""
    return F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter == "M", "modified").when(letter == "T", "type_changed").otherwise(letter)


def fingerprint(hashes: DataFrame) -> DataFrame:
    """One row: SHA-256 of the JSON object of paths and hashes, sorted by path.

    The digest of one text can only be made in order: rows of 100 bytes a file
    are sorted, on disk where they don't fit, and read through once, a batch at a
    time.  For trees that are too large for one task, and to find out what
    changed, there is ``manifest.tree``.
    """
    workers_import_this(hashes.sparkSession)
    quoted = F.to_json(F.array("path"))
    pairs = hashes.where(F.col("hash").isNotNull()).select("path", F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(': "'), "hash", F.lit('"')).alias("pair"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, between = hashlib.sha256(b"{"), b""
        for batch in batches:
            for pair in batch.column(0):
                digest.update(between + pair.as_buffer().to_pybytes())
                between = b", "
        digest.update(b"}")
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["fingerprint"])

    return pairs.repartition(1).sortWithinPartitions("path", "pair").select("pair").mapInArrow(read, "fingerprint string")
