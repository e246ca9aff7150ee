"""A hash tree over files: one hash says whether anything changed, and a walk down says what.

A folder's hash is that of its children's names and hashes.  Children are
gathered by the first byte of their names' MD5, so that a folder of very many
files is never in one row.  Levels are joined by their parents; equal subtrees
are not looked into.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stage

NODES = "path string, parent string, level int, hash string, file boolean"


def files_of(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(path, hash) of all files of the driver's folders, below the folders' names; links are not followed.

    Spark's reader of whole files passes over empty ones, so names are listed
    and what it doesn't give is the hash of nothing.
    """
    rows, names = spark.createDataFrame([], "path string, hash string"), []
    for name, folder in sorted(folders.items()):
        base = os.path.realpath(folder)
        inside = [os.path.relpath(os.path.join(at, f), base) for at, _, files in os.walk(base) for f in files]
        names += [(f"{name}/{path}",) for path in inside if not path.endswith(".pyc")]
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{base}")
        rows = rows.unionByName(found.select(F.concat(F.lit(f"{name}/"), F.expr(f"substring(path, {len('file:' + base) + 2})")).alias("path"), F.sha2("content", 256).alias("hash")))
    listed = spark.createDataFrame(names, "path string")
    return listed.join(rows, "path", "left").select("path", F.coalesce("hash", F.sha2(F.lit(b""), 256)).alias("hash"))


def _digest(rows: DataFrame, *by: str) -> DataFrame:
    """One hash for the children (name, hash) of each group."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "hash"))), lambda c: F.concat_ws(" ", c["hash"], c["name"])), "\n")
    return rows.groupBy(*by).agg(F.sha2(listed, 256).alias("hash"))


def parent_of(path: Column) -> Column:
    """The folder of a path; the root is the empty path."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def tree(files: DataFrame) -> DataFrame:
    """All nodes (path, parent, level, hash, file) of (path, hash): files, folders, and the root with the empty path and level 0.

    Paths have no empty part.  A path that comes twice counts once, with its
    least hash; null paths are left out, null hashes are empty.  No files give no
    nodes.  A file and a folder of one path are two nodes.
    """
    leaves = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.coalesce(F.min("hash"), F.lit("")).alias("hash"))
    leaves = stage(leaves.select("path", parent_of(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("level"), "hash", F.lit(True).alias("file")), "tree-files")
    nodes, below = leaves, leaves
    for level in range(leaves.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0], 0, -1):
        children = below.where(F.col("level") == level).select("parent", F.concat(F.substring_index("path", "/", -1), F.when(F.col("file"), "").otherwise("/")).alias("name"), "hash")
        shards = _digest(children.withColumn("shard", F.substr(F.md5("name"), F.lit(1), F.lit(2))), "parent", "shard")
        own = _digest(shards.select("parent", F.col("shard").alias("name"), "hash"), "parent")
        folders = own.select(F.col("parent").alias("path"), F.when(F.col("parent") != "", parent_of(F.col("parent"))).alias("parent"), F.lit(level - 1).alias("level"), "hash", F.lit(False).alias("file"))
        folders = stage(folders, "tree-level")
        nodes = nodes.unionByName(folders)
        below = leaves.unionByName(folders)
    return nodes


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of the files that two trees don't have alike: added, removed or changed.

    Goes down from the root, level by level, through folders whose hashes
    differ; what is below equal hashes is left out of every join.
    """
    spark = old.sparkSession
    found = spark.createDataFrame([], "path string, change string")
    at = spark.createDataFrame([("",)], "path string")
    roots = [n.where("level = 0").select("hash") for n in (old, new)]
    if [r.hash for r in roots[0].collect()] == [r.hash for r in roots[1].collect()]:
        return found
    depth = old.select("level").union(new.select("level")).agg(F.max("level")).first()[0] or 0
    for level in range(1, depth + 1):
        mine, theirs = (n.where(F.col("level") == level).join(at.select(F.col("path").alias("parent")), "parent", "left_semi").select("path", "file", F.col("hash").alias(h)) for n, h in ((old, "was"), (new, "is")))
        met = stage(mine.join(theirs, ["path", "file"], "full").where(~F.col("was").eqNullSafe(F.col("is"))), "tree-differences")
        change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
        found = found.unionByName(met.where("file").select("path", change.alias("change")))
        at = met.where("NOT file").select("path")
        if at.isEmpty():
            break
    return found
