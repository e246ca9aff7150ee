"""Linking call facts to definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Of rows with one key, the one with the greatest ``order``."""
    names = list(dict.fromkeys([order, *values]))
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_last")).select(key, *[F.col(f"_last.{v}").alias(v) for v in names])


def qualified(symbols: DataFrame) -> DataFrame:
    """(candidate, id): a symbol's dotted name; the last path wins, then its last definition."""
    named = symbols.select(F.concat_ws(".", "module", "name").alias("candidate"), "path", "start", "id")
    return named.groupBy("candidate").agg(F.max(F.struct("path", "start", "id")).alias("_last")).select("candidate", F.col("_last.id").alias("id"))


def candidate(parts: Column, module: Column, owner: Column, target: Column) -> Column:
    """What a dotted call means: a method of the own class, an alias's target, or the own module's."""
    head, rest = F.element_at(parts, 1), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    own = head.isin("self", "cls") & owner.isNotNull() & (F.size(parts) == 2)
    return (
        F.when(own, F.concat_ws(".", module, owner, F.element_at(parts, 2)))
        .when(target.isNotNull(), F.concat_ws(".", F.array(target), rest))
        .otherwise(F.concat_ws(".", F.array(module), parts))
    )


def link(calls: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) from call facts (symbol, parts).

    ``aliases`` has (module, name, target), one row per module and name.
    Candidates that name no symbol give no edge.
    """
    facts = calls.join(symbols.select(F.col("id").alias("symbol"), "module", "owner"), "symbol").withColumn("name", F.element_at("parts", 1))
    resolved = facts.join(aliases.select("module", "name", "target"), ["module", "name"], "left")
    named = resolved.select(F.col("symbol").alias("src"), candidate(F.col("parts"), F.col("module"), F.col("owner"), F.col("target")).alias("candidate"))
    return named.join(qualified(symbols), "candidate").select("src", F.col("id").alias("dst")).distinct()


#: Suffixes that a script's name may stand for.
TYPED = (".ts", ".tsx", ".mts")


def unique(rows: DataFrame, key: str, value: str, exact: Column) -> DataFrame:
    """(key, value): the exact match if there is one, else the only one; keys with several are dropped."""
    found = rows.groupBy(key).agg(F.min(F.when(exact, F.col(value))).alias("_exact"), F.count_distinct(value).alias("_n"), F.min(value).alias("_one"))
    return found.select(key, F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_one"))).alias(value)).where(F.col(value).isNotNull())


def without_conflicts(exports: DataFrame) -> DataFrame:
    """(path, export, local): exports that are bound to one local name only."""
    return exports.groupBy("path", "export").agg(F.count_distinct("local").alias("_n"), F.min("local").alias("local")).where("_n = 1").drop("_n")


def resolve_modules(imports: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """(path, module, target): files that relative module names mean.

    ``imports`` has (path, module, base), base being the name joined to the
    importing file's folder.  A file of exactly that name wins; else, if there
    is just one, what a script's name stands for in the typed language, or for a
    name without a suffix the base with one, or its folder's index file.
    """
    typed = [s for s in suffixes if s in TYPED]
    script = F.regexp_replace("base", r"\.(js|jsx|mjs)$", "")
    bare = F.array("base", *[F.concat("base", F.lit(x + s)) for x in ("", "/index") for s in suffixes])
    options = (
        F.when(script != F.col("base"), F.array("base", *[F.concat(script, F.lit(s)) for s in typed]))
        .when(F.col("base").rlike(r"\.(ts|tsx|mts)$"), F.array("base")).otherwise(bare)
    )
    spread = imports.select("path", "module", "base", F.explode(F.array_distinct(options)).alias("target"))
    found = spread.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    picked = found.withColumn("key", F.struct("path", "module"))
    return unique(picked, "key", "target", F.col("target") == F.col("base")).select("key.path", "key.module", "target")


def link_web(calls: DataFrame, symbols: DataFrame, modules: DataFrame, exports: DataFrame, unsafe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and the count of unresolved calls per symbol, from web-language facts.

    Local calls go to a symbol of the same file; imported ones by way of the
    module and its export.  Bindings that are reassigned (``unsafe``: path,
    name) resolve nothing.
    """
    facts = calls.join(symbols.select(F.col("id").alias("symbol"), "path"), "symbol")
    local = facts.where("kind = 'local'").join(unsafe.select("path", "name"), ["path", "name"], "left_anti").select("symbol", F.concat_ws(":", "path", "name").alias("id"))
    imported = facts.where("kind = 'import'").join(modules, ["path", "module"]).select("symbol", F.col("target").alias("path"), "export")
    imported = imported.join(exports, ["path", "export"]).join(unsafe.select("path", F.col("name").alias("local")), ["path", "local"], "left_anti").select("symbol", F.concat_ws(":", "path", "local").alias("id"))
    hits = local.unionByName(imported).join(symbols.select("id"), "id", "left_semi")
    made = hits.groupBy("symbol").agg(F.count("*").alias("hits"))
    missed = facts.groupBy("symbol").agg(F.count("*").alias("calls")).join(made, "symbol", "left").select("symbol", (F.col("calls") - F.coalesce("hits", F.lit(0))).alias("unresolved")).where("unresolved > 0")
    return hits.select(F.col("symbol").alias("src"), F.col("id").alias("dst")).distinct(), missed
