"""License scan: fixed phrases, and an exact set-similarity join with license templates.

A template is the set of its words.  A block is any run of consecutive words of
a text, a quarter longer than the template; it meets the template if it holds
the wanted part of the template's set.  Every block that does is found:

* Words are ordered by how many documents have them, rarest first, in all the
  documents that are scanned (``frequencies``).
* Prefix filter: a block that shares ``least`` of a template's ``n`` words has one
  of its ``n - least + 1`` rarest, so only words around those are looked at.
* Length filter: a text with fewer words than ``least``, and a stretch with fewer
  words of the template than that, can't meet it.
* Positional filter: a stretch whose rarest word is the template's word number r
  shares at most those from r on, of which it must have ``least``.

What is left is counted word by word, as a window goes over the stretch.
Templates are broadcast: they are a parameter, bounded by ``MOST_WORDS``.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import text_or_empty, workers_import_this


@dataclass(frozen=True)
class Template:
    """A license text.  Of overlapping blocks that meet templates of one family, only the best counts."""

    label: str
    family: str
    text: str
    #: Part of the template's different words that a block must hold.
    containment: float = 0.8


#: Different words of all templates together, at most; they are sent to all tasks.
MOST_WORDS = 100_000
#: Words of a block for each word of its template.
ROOM = 1.25
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

# The phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices of public licenses.  Short ones must be met by all their words.
TEMPLATES = (
    Template("mit", "mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software."""),
    Template("mit", "mit", "licensed under MIT license", 1.0),
    Template("mit", "mit", "released under MIT license", 1.0),
    Template("isc", "isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    Template("bsd-2", "bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.""", 0.85),
    Template("bsd-3", "bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission.""", 0.85),
    Template("apache-2", "apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License."""),
    Template("apache-2", "apache", "under Apache License 2.0", 1.0),
    Template("mpl-2", "mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    Template("mpl-2", "mpl", "Mozilla Public License 2.0", 1.0),
    Template("gpl-3", "gnu", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", 0.9),
    Template("gpl-2", "gnu", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""", 0.9),
    Template("lgpl", "gnu", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version of the License, or (at your option) any later version.""", 0.9),
    Template("agpl-3", "gnu", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", 0.9),
    Template("gpl", "gnu", "GNU General Public License", 1.0),
    Template("gpl-2", "gnu", "GNU General Public License version 2", 1.0),
    Template("gpl-3", "gnu", "GNU General Public License version 3", 1.0),
    Template("lgpl", "gnu", "GNU Lesser General Public License", 1.0),
    Template("lgpl", "gnu", "GNU Lesser General Public License version", 1.0),
    Template("agpl-3", "gnu", "GNU Affero General Public License", 1.0),
    Template("agpl-3", "gnu", "GNU Affero General Public License version 3", 1.0),
    Template("unlicense", "unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means."""),
    Template("cc0", "cc", "Creative Commons CC0 1.0 Universal public domain dedication"),
    Template("cc-by", "cc", "Creative Commons Attribution International License", 1.0),
    Template("cc-by-sa", "cc", "Creative Commons Attribution ShareAlike International License", 1.0),
    Template("cc-by-nc", "cc", "Creative Commons Attribution NonCommercial International License", 1.0),
    Template("cc-by-nc", "cc", "licensed under CC BY NC", 1.0),
)

# What is no part of a word becomes a space, A to Z small letters; bytes from 0x80 on stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "n_words long, places array<struct<label:string,word:long>>, blocks array<struct<label:string,first:long,last:long,containment:double>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a folded text, some of them at a time; no word is cut."""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Sets:
    """Templates as sets of words in the order of their frequency."""

    def __init__(self, templates: Iterable[Template], frequency: dict[str, int]):
        self.templates = tuple(templates)
        self.ranks: list[dict[bytes, int]] = []
        self.least: list[int] = []
        self.room: list[int] = []
        #: For each word, the templates that have it in their prefix.
        self.prefixes: dict[bytes, list[int]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            words = words_of(t.text)
            order = sorted(set(words), key=lambda w: (frequency.get(w.decode(), 0), w))
            least = math.ceil(t.containment * len(order) - 1e-9)
            self.ranks.append({w: r for r, w in enumerate(order)})
            self.least.append(least)
            self.room.append(max(len(words), math.ceil(ROOM * len(words))))
            for w in order[: len(order) - least + 1]:
                self.prefixes[w].append(i)

    def blocks(self, n_words: int, met: dict[bytes, list[int]]) -> list[tuple[int, int, int, float]]:
        """Template, first word, last word and containment of the best block of every stretch that meets a template.

        ``met``: the places of each word that a template has.
        """
        candidates = {i for w in met.keys() & self.prefixes.keys() for i in self.prefixes[w]}
        found = []
        for i in sorted(candidates):
            ranks, least, room = self.ranks[i], self.least[i], self.room[i]
            shared = [w for w in ranks if w in met]
            if n_words < least or len(shared) < least:
                continue
            places = sorted((p, ranks[w]) for w in shared for p in met[w])
            starts = [p for p, _ in places]
            size = len(ranks)
            prefix = [p for p, r in places if r <= size - least]
            for a, b in _joined(prefix, room):
                stretch = places[bisect_left(starts, a) : bisect_right(starts, b)]
                rarest = min(r for _, r in stretch)
                if min(size - rarest, len({r for _, r in stretch})) < least:
                    continue
                found += [(i, first, last, n / size) for first, last, n in _best(stretch, least, room)]
        return found

    def labelled(self, blocks: list[tuple[int, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Label, first and last word and containment of the blocks that count: those with none better of their family over them.

        Better is the larger containment, then the larger template, then the smaller label.
        """
        order = sorted(blocks, key=lambda b: (-b[3], -len(self.ranks[b[0]]), self.templates[b[0]].label, b[1]))
        out: list[tuple[str, int, int, float]] = []
        taken: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, first, last, containment in order:
            spans = taken[self.templates[i].family]
            at = bisect_left(spans, (first, first))
            if (at and spans[at - 1][1] >= first) or (at < len(spans) and spans[at][0] <= last):
                continue
            spans.insert(at, (first, last))
            out.append((self.templates[i].label, first, last, containment))
        return sorted(out, key=lambda b: (b[1], b[2], b[0]))


def _joined(places: list[int], room: int) -> Iterator[tuple[int, int]]:
    """Stretches that hold every block of ``room`` words around the places (in order)."""
    a = b = None
    for p in places:
        if b is not None and p - room < b:
            b = p + room - 1
            continue
        if b is not None:
            yield a, b
        a, b = max(0, p - room + 1), p + room - 1
    if b is not None:
        yield a, b


def _best(stretch: list[tuple[int, int]], least: int, room: int) -> Iterator[tuple[int, int, int]]:
    """The best of the blocks that overlap each other and have ``least`` different words: first and last shared word, and how many.

    A block begins with a word of the template: one that doesn't shares no more than the one that begins later.
    """
    inside: Counter[int] = Counter()
    j, best = 0, None
    for i, (first, rank) in enumerate(stretch):
        while j < len(stretch) and stretch[j][0] < first + room:
            inside[stretch[j][1]] += 1
            j += 1
        n = len(inside)
        if n >= least:
            last = stretch[j - 1][0]
            if best and first > best[1]:
                yield best
                best = None
            if best is None or n > best[2]:
                best = (first, last, n)
        inside[rank] -= 1
        if not inside[rank]:
            del inside[rank]
    if best:
        yield best


def frequencies(spark: SparkSession, docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[str, int]:
    """In how many of all documents each word of the vocabulary stands.

    A task passes on a count for each word, so little is shuffled; the driver
    gets a row for each word of the templates.
    """
    workers_import_this(spark)
    shared = spark.sparkContext.broadcast(frozenset(vocabulary))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = shared.value, Counter()
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                met: set[bytes] = set()
                for words in pieces(t.as_py().translate(_FOLD)):
                    met |= vocabulary.intersection(words)
                counts.update(met)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text_or_empty(text).alias("text")).mapInArrow(counted, "word string, n long")
    return {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(spark: SparkSession, docs: DataFrame, templates: Iterable[Template] = TEMPLATES, phrases: dict[str, str] = PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its number of words, the places of the phrases, and the blocks that meet a template.

    Words are counted from 0; a block's ``last`` is its last word.  Texts are
    scanned whole, however long, some words at a time; null and empty texts have
    no words.  A place counts for each phrase that stands there, and places may
    overlap.  Rows are independent: repeated rows repeat, an empty table gives
    an empty one, other columns are not read.  Templates or phrases without
    words are an error, as are more words than ``MOST_WORDS``.
    """
    templates = tuple(templates)
    listed = [(tuple(words_of(p)), label) for p, label in phrases.items()]
    vocabulary = {w for t in templates for w in words_of(t.text)}
    if not all(words_of(t.text) for t in templates) or not all(p for p, _ in listed):
        raise ValueError("a template and a phrase need a word")
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the templates have {len(vocabulary)} different words, more than {MOST_WORDS}")
    slim = docs.select(F.col(key), text_or_empty(text).alias("text"))
    sets = spark.sparkContext.broadcast(Sets(templates, frequencies(spark, docs, vocabulary, text)))
    wanted = spark.sparkContext.broadcast(frozenset(vocabulary | {w for p, _ in listed for w in p}))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words_wanted = sets.value, wanted.value
        for batch in batches:
            rows = []
            for t in batch.column(1).cast(pa.binary()):
                n, met = places_of(t.as_py(), words_wanted)
                blocks = own.labelled(own.blocks(n, met))
                rows.append((n, phrase_places(met, listed), [dict(zip(("label", "first", "last", "containment"), b, strict=True)) for b in blocks]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], [key, "n_words", "places", "blocks"])

    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    block = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())])
    kinds = (pa.int64(), pa.list_(place), pa.list_(block))
    return slim.mapInArrow(scanned, f"{key} {slim.schema[key].dataType.simpleString()}, {SCHEMA}")


def places_of(data: bytes, wanted: frozenset[bytes]) -> tuple[int, dict[bytes, list[int]]]:
    """A text's number of words, and where those that are wanted stand."""
    met: dict[bytes, list[int]] = defaultdict(list)
    n = 0
    for words in pieces(data.translate(_FOLD)):
        if not wanted.isdisjoint(words):
            for i, w in enumerate(words, n):
                if w in wanted:
                    met[w].append(i)
        n += len(words)
    return n, met


def phrase_places(met: dict[bytes, list[int]], phrases: list[tuple[tuple[bytes, ...], str]]) -> list[dict]:
    found = []
    for words, label in phrases:
        if all(w in met for w in words):
            # from the word with the fewest places, the others are looked up
            at = {w: set(met[w]) for w in words}
            k = min(range(len(words)), key=lambda k: len(at[words[k]]))
            found += [{"label": label, "word": p - k} for p in met[words[k]] if all(p - k + i in at[w] for i, w in enumerate(words))]
    return sorted(found, key=lambda x: (x["word"], x["label"]))


def summarised(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``scan`` as counts, labels and a score: 1 with a base place, else the best block's containment, else 0."""
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("blocks.label"))))
    return scanned.select(
        key, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
    )
