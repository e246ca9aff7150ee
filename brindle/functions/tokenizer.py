"""The tokenizer of ``text.tokens`` for corpora, as Arrow functions.

Splitting every occurrence of a word with array functions costs some 25
microseconds a word in the JVM, which interprets them; words repeat, so a
worker that remembers what a word gives needs a fraction of one.  Both give the
same terms (see the tests).
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CAMEL, STOPWORDS, WORD

_WORD, _CAMEL, _STOP = re.compile(WORD), re.compile(CAMEL), frozenset(STOPWORDS)
#: Words that a worker remembers before it starts afresh, and how long they may be: it holds some 50 MB of them
#: at most, however many different words a table has and however long they are.
REMEMBERED, LONGEST = 150_000, 64


def stems(part: str) -> Iterator[str]:
    """A part and what its ending makes of it."""
    yield part
    n = len(part)
    if n > 5 and part.endswith("ing"):
        yield part[:-3]
    if n > 4 and part.endswith("ies"):
        yield part[:-3] + "y"
    elif n > 3 and part.endswith("s") and not part.endswith(("ss", "us", "is")):
        yield part[:-1]


def word_terms(word: str) -> tuple[str, ...]:
    """Sorted terms of a word."""
    parts = {word.lower()}
    if not (word.isalpha() and (word.islower() or word.isupper() or word[1:].islower())):  # others are their only part
        parts.update(p.lower() for piece in word.split("_") for p in _CAMEL.findall(piece))
    found = {t for p in parts for t in stems(p)}
    return tuple(sorted(t for t in found if t and t not in _STOP and not t.isdigit()))


class _Terms(dict):
    """Word to its sorted terms."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        value = word_terms(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_TERMS = _Terms()


def text_terms(text: str | None) -> list[str]:
    return list(itertools.chain.from_iterable(map(_TERMS.__getitem__, _WORD.findall(text or ""))))


def text_counts(text: str | None) -> dict[str, int]:
    """The different terms of a text, and how often each stands in it."""
    out: dict[str, int] = {}
    for word, n in Counter(_WORD.findall(text or "")).items():
        for t in _TERMS[word]:
            out[t] = out.get(t, 0) + n
    return out


class Wanted(dict):
    """Counts of some terms in texts.  As a dict: word to its number of terms; words with a wanted term are in ``places``, too."""

    def __init__(self, terms: Iterable[str]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.places: dict[str, list[int]] = {}
        self.long: list[str] = []

    def __missing__(self, word: str) -> int:
        found = word_terms(word)
        met = [self.place[t] for t in found if t in self.place]
        if met:
            self.places[word] = met
        if len(word) <= LONGEST:
            self[word] = len(found)
        else:
            self.long.append(word)
        return len(found)

    def count(self, text: str | None) -> tuple[int, dict[int, int]]:
        """How many terms a text has, and how often each wanted one that occurs does, by its place."""
        words = Counter(_WORD.findall(text or ""))
        if len(self) + len(words) > REMEMBERED:  # none of this text's words is forgotten before its terms are counted
            self.clear()
            self.places.clear()
        length = sum(map(mul, map(self.__getitem__, words), words.values()))
        out: dict[int, int] = {}
        for word in words.keys() & self.places.keys():
            for i in self.places[word]:
                out[i] = out.get(i, 0) + words[word]
        while self.long:
            self.places.pop(self.long.pop(), None)
        return length, out


def lists(values: Iterable[Iterable], kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists, without a Python list of them all."""
    flat, ends = [], [0]
    for v in values:
        flat.extend(v)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def corpus_tokens(text: Column) -> Column:
    """Terms of each text, in order."""
    return F.arrow_udf(lambda texts: lists((text_terms(t.as_py()) for t in texts), pa.string()), "array<string>")(text)


def distinct_tokens(text: Column) -> Column:
    """Different terms of each text."""
    return F.arrow_udf(lambda texts: lists((set(text_terms(t.as_py())) for t in texts), pa.string()), "array<string>")(text)


def term_frequencies(text: Column, terms: list[str]) -> Column:
    """struct<len, tf>: how many terms a text has, and how often each given one occurs."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wanted = Wanted(terms)
        for texts in batches:
            length, tf = [], []
            for t in texts:
                n, met = wanted.count(t.as_py())
                length.append(n)
                tf.append([met.get(i, 0) for i in range(len(terms))])
            yield pa.StructArray.from_arrays([pa.array(length, pa.int32()), lists(tf, pa.int32())], ["len", "tf"])

    return F.arrow_udf(count, "len int, tf array<int>")(text)
