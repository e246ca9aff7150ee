"""Column functions for identifiers, sizes and digests; all stay in the JVM."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns and the words that are no search terms.
WORD = r"[A-Za-z_][A-Za-z_0-9]*"
CAMEL = r"[A-Z]+(?=[A-Z][a-z]|[0-9]|$)|[A-Z]?[a-z]+|[0-9]+"
STOPWORDS = """
a an and are as at be been being by can could did do does for from had has have
how i in into is it its of on or our should so than that the their them then there
these they this those to was we were what when where which who why will with would
you your please fix bug change implement update code function def class const let
var return import export default async await self true false none null undefined
""".split()


def variants(term: Column) -> Column:
    """A lower-case term and, for some endings, its stem; nulls where a rule doesn't apply."""
    n = F.length(term)
    ies = (n > 4) & term.endswith("ies")
    plural = (n > 3) & term.endswith("s") & ~term.endswith("ss") & ~term.endswith("us") & ~term.endswith("is")
    return F.array(
        term,
        F.when((n > 5) & term.endswith("ing"), F.substr(term, F.lit(1), n - 3)),
        F.when(ies, F.concat(F.substr(term, F.lit(1), n - 3), F.lit("y"))).when(plural, F.substr(term, F.lit(1), n - 1)),
    )


def word_tokens(word: Column) -> Column:
    """Distinct sorted search terms of one identifier: itself, its parts, and their stems."""
    pieces = F.flatten(F.transform(F.split(word, "_"), lambda p: F.regexp_extract_all(p, F.lit(CAMEL), F.lit(0))))
    parts = F.array_distinct(F.concat(F.array(F.lower(word)), F.transform(pieces, F.lower)))
    every = F.flatten(F.transform(parts, variants))
    stop = F.array(*map(F.lit, STOPWORDS))
    wanted = F.filter(every, lambda t: t.isNotNull() & (t != "") & ~t.rlike("^[0-9]+$"))
    return F.array_sort(F.array_except(wanted, stop))


def tokens(text: Column) -> Column:
    """Search terms of a text in order; terms repeat with the words. Null gives null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.flatten(F.transform(words, word_tokens))


def plain_words(text: Column) -> Column:
    """Distinct words of the lower-cased text, identifiers unsplit."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def token_estimate(text: Column) -> Column:
    """UTF-8 bytes over three, rounded up."""
    return F.ceil(F.octet_length(text) / 3).cast("long")


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def casefold(text: str) -> str:
    """Python's folding, for the driver's short strings."""
    return text.strip().casefold()


def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else t.casefold() for t in texts.to_pylist()], pa.string())


def folded(column: str) -> Column:
    """Python's folding of a column (``straße`` and ``STRASSE`` are alike), a batch at a time; computed once where a table is staged."""
    return F.arrow_udf(_folded, "string")(F.col(column))
