"""URL filter: host and path rules, then a character language-model ratio.

Two variable-order Markov models over characters, for accepted and for rejected
URLs, share one table of contexts.  A URL's score is the difference of its
log-likelihoods per character; the threshold is calibrated on labelled URLs
that the models were not fitted on.  The models count all other labelled URLs
and are joined with the different grams of the URLs to score, both of any size.
DataFrame and SQL functions only.

Smoothing is by interpolation (Witten and Bell): with n(x) the number of
characters seen after context x, and t(x) the number of different ones,

    P(c | x) = (n(xc) + t(x) P(c | x')) / (n(x) + t(x))

where x' is x without its first character, down to a uniform distribution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize, named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains, if the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    #: Characters of context, at most.
    order: int = 4
    #: Contexts seen less often in both classes together are not kept, nor what follows them.
    least: int = 3
    #: One of so many labelled URLs, by the hash, is for calibration.
    calibrate: int = 5
    #: Symbols that the uniform distribution is over.
    alphabet: int = 128
    #: Bins of the score that calibration looks at, per unit.
    bins: int = 50


def host_of(url: str = "url") -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    """From the host's end to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.regexp_replace(_after_scheme(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _after_scheme(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct<name, verdict>; null if none does."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """A row per character: itself after the ``order`` characters before it (``g``).

    A URL is lower-cased and ends with a line feed; it begins after ``order`` of
    these.  U+0000 and line feeds in it, which mean something to the model, count
    as U+FFFD.
    """
    padded = F.concat(F.lit("\n" * order), F.translate(F.lower("url"), "\0\n", "\ufffd\ufffd"), F.lit("\n"))
    at = urls.withColumn("_s", padded).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_s") - order)))
    return at.withColumn("g", F.substr(F.col("_s"), F.col("_at"), F.lit(order + 1))).drop("_s", "_at")


def _shorter(grams: DataFrame, order: int) -> DataFrame:
    """A row per gram and k: the character at its end (``c``) and the k before it (``x``)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(order)))
    return grams.withColumn("k", k).withColumn("x", F.substr(F.col("g"), order + 1 - F.col("k"), F.col("k"))).withColumn("c", F.substr(F.col("g"), F.lit(order + 1), F.lit(1)))


def parted(labelled: DataFrame, settings: Settings) -> DataFrame:
    """All rows (url, accepted) and whether they are for calibration.

    Equal URLs are on one side, and each class's least hash is on the models'.
    """
    rows = labelled.select("url", "accepted", F.xxhash64("url").alias("h"))
    least = [r.h for r in rows.groupBy("accepted").agg(F.min("h").alias("h")).collect()]  # two rows
    return rows.select("url", "accepted", ((F.pmod("h", F.lit(settings.calibrate)) == 0) & ~F.col("h").isin(least)).alias("apart"))


def fit(spark: SparkSession, labelled: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, float] | None:
    """The model table (g string, gain double) and the threshold, from rows (url, accepted).

    With r(x, c) = log P(c|x) under the accepted model less that under the
    rejected one, an entry is one of:

    * a context and a character seen after it: r(x, c) - r(x', c), or r(x, c)
      for the empty context;
    * a context and a zero character: what it adds to r when a character was
      never seen after it.

    So a character's r is the sum, over its contexts, of the entry that fits.
    None if a class has no row.
    """
    rows = materialize(spark, parted(labelled, settings), "url-labelled")
    if rows.select("accepted").distinct().count() < 2:
        return None
    longest = (
        _grams(rows.where("NOT apart").select("url", "accepted"), settings.order).groupBy("g")
        .agg(F.count_if("accepted").alias("na"), F.count_if(~F.col("accepted")).alias("nr"))
    )
    counts = _shorter(longest, settings.order).groupBy("k", "x", "c").agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
    counts = materialize(spark, counts, "url-counts")
    totals = counts.groupBy("k", "x").agg(F.sum("na").alias("ta"), F.sum("nr").alias("tr"), F.count_if(F.col("na") > 0).alias("da"), F.count_if(F.col("nr") > 0).alias("dr"))
    kept = totals.where((F.col("ta") + F.col("tr") >= settings.least) | (F.col("k") == 0))
    seen = counts.join(kept, ["k", "x"])
    done, entries = None, kept.select(F.concat("x", F.lit("\0")).alias("g"), F.log(_escape("ta", "da") / _escape("tr", "dr")).alias("gain"))
    for k in range(settings.order + 1):  # from short contexts to long ones
        own = seen.where(F.col("k") == k)
        if done is None:
            own = own.withColumns({"la": F.lit(1.0 / settings.alphabet), "lr": F.lit(1.0 / settings.alphabet)})
        else:
            shorter = done.select(F.col("x").alias("y"), "c", F.col("pa").alias("la"), F.col("pr").alias("lr"))
            own = own.withColumn("y", F.substr(F.col("x"), F.lit(2))).join(shorter, ["y", "c"])
        own = own.withColumns({"pa": _mixed("na", "ta", "da", "la"), "pr": _mixed("nr", "tr", "dr", "lr")})
        done = materialize(spark, own.select("k", "x", "c", "na", "nr", "pa", "pr", "la", "lr"), f"url-order{k}")
        gain = F.log(F.col("pa") / F.col("pr")) - F.log(F.col("la") / F.col("lr"))
        entries = entries.unionByName(done.select(F.concat("x", "c").alias("g"), gain.alias("gain")))
    model = materialize(spark, entries, "url-model")
    apart = materialize(spark, rows.where("apart").groupBy("url").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")), "url-apart")
    scores = scored(apart, model, settings, ["url"]).join(apart, "url").withColumn("bin", F.floor(F.col("score") * settings.bins))
    bins = scores.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    return model, calibrated(sorted(tuple(b) for b in bins.collect()), settings.bins)  # as many rows as bins


def _mixed(n: str, total: str, different: str, shorter: str) -> Column:
    seen = F.col(total) + F.col(different)
    return F.when(seen > 0, (F.col(n) + F.col(different) * F.col(shorter)) / seen).otherwise(F.col(shorter))


def _escape(total: str, different: str) -> Column:
    seen = F.col(total) + F.col(different)
    return F.when(seen > 0, F.col(different) / seen).otherwise(F.lit(1.0))


def calibrated(bins: list[tuple[int, int, int]], per_unit: int) -> float:
    """The score from which accepting gives the best balanced accuracy.

    ``bins`` has (bin, accepted, rejected) in order.  A threshold between two
    bins lies in the middle of the gap; among equals the one nearest to zero is
    taken; zero if a class has no row.
    """
    a, r = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not a or not r:
        return 0.0
    found, below_a, below_r = [], 0, 0
    for (last, na, nr), (bin_, _, _) in zip([(bins[0][0] - 1, 0, 0), *bins], [*bins, (bins[-1][0] + 1, 0, 0)], strict=True):
        below_a, below_r = below_a + na, below_r + nr
        edge = (last + 1 + bin_) / 2 / per_unit
        found.append(((a - below_a) / a + below_r / r, -abs(edge), edge))
    return max(found)[2]


def scored(urls: DataFrame, model: DataFrame, settings: Settings, keys: list[str]) -> DataFrame:
    """``keys`` (of a row, with its url) and ``score``: the log-likelihood difference per character.

    The model is looked up once for each different gram of all the URLs.  Rows
    have a number, so that a gram does not carry its URL along.
    """
    spark, order = urls.sparkSession, settings.order
    rows = urls.select(*dict.fromkeys([*keys, "url"])).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(spark, rows, "urls-to-score")
    grams = _grams(rows.select("_row", "url"), order).select("_row", "g")
    pieces = _shorter(grams.select("g").distinct(), order).select("g", F.concat("x", "c").alias("g1"), F.concat("x", F.lit("\0")).alias("g2"))
    pieces = materialize(spark, pieces.join(model.select(F.col("g").alias("g1"), "gain"), "g1", "left"), "url-grams")
    unseen = pieces.where("gain IS NULL").select("g", "g2").join(model.select(F.col("g").alias("g2"), "gain"), "g2")
    gains = pieces.where("gain IS NOT NULL").select("g", "gain").unionByName(unseen.select("g", "gain")).groupBy("g").agg(F.sum("gain").alias("gain"))
    gains = materialize(spark, gains, "url-gains")
    scores = grams.join(gains, "g", "left").groupBy("_row").agg((F.sum(F.coalesce("gain", F.lit(0.0))) / F.count("*")).alias("score"))
    return rows.join(scores, "_row").select(*keys, "score")


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], settings: Settings = Settings(), key: str = "page_id") -> DataFrame:
    """Per row: key, host, path, rule, verdict and score.

    A rule decides where one fits; else the models, fitted on the URLs that the
    rules decide; without URLs of both verdicts, or for a null URL, ``allow``.
    Equal keys with equal URLs repeat; other columns are not read; an empty
    table gives an empty one.  ``score`` is null where the models weren't asked.
    """
    ruled = pages.select(*named([key]), "url", host_of().alias("host"), path_of().alias("path")).withColumn("_rule", rule_of(rules, F.col("host"), F.col("path")))
    labelled = ruled.where(F.col("_rule").isNotNull()).select("url", (F.col("_rule.verdict") == "allow").alias("accepted"))
    fitted = fit(spark, labelled, settings)
    out = ruled.select(*named([key]), "url", "host", "path", F.col("_rule.name").alias("rule"), F.col("_rule.verdict").alias("_ruled"))
    if fitted is None:
        return out.select(*named([key]), "host", "path", "rule", F.coalesce("_ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    model, threshold = fitted
    # only URLs that no rule decides are looked up; all others go their own way
    asked = F.col("_ruled").isNull() & F.col("url").isNotNull()
    scores = scored(out.where(asked).select("url").distinct(), model, settings, ["url"])
    scores = materialize(spark, scores, "url-scores")
    # two plain tables: where one URL has very many rows, Spark deals that partition to several tasks
    judged = out.where(asked).join(scores, "url")
    plain = out.where(~asked).withColumn("score", F.lit(None).cast("double"))
    every = judged.select(*plain.columns).unionByName(plain)
    verdict = F.coalesce("_ruled", F.when(F.col("score") < threshold, "block"), F.lit("allow"))
    return every.select(*named([key]), "host", "path", "rule", verdict.alias("verdict"), "score")
