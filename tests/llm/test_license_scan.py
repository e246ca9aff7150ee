"""License scan against a plain version: every window of every text, every place of every phrase."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.llm import license_scan, queries
from brindle.llm.license_scan import PHRASES, TEMPLATES, Sets, Template

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(words, phrases=PHRASES):
    found = []
    for phrase, label in phrases.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(found)


def plain_windows(words, template):
    """First word and number of shared different words of every window that meets the template."""
    listed = plain_words(template.text)
    wanted, room = set(listed), math.ceil(1.25 * len(listed))
    least = math.ceil(template.containment * len(wanted) - 1e-9)
    counted = [(a, len(wanted & set(words[a : a + room]))) for a in range(max(1, len(words)))]
    return [(a, n) for a, n in counted if n >= least], room, len(wanted)


SMALL = (Template("x", "f", "red green blue black white"), Template("y", "f", "red green blue black white grey", 0.7), Template("z", "g", "pink blue", 1.0), Template("v", "h", "black black red pink", 0.5))


def random_text(rng, n):
    return " ".join(rng.choices(["Red", "green", "blue", "black", "white", "grey", "pink", "other", "word", "ré", "x1", "_"], [2, 2, 2, 1, 1, 1, 1, 6, 9, 2, 2, 2], k=n))


@pytest.mark.parametrize("seed", range(4))
def test_every_block_is_found(seed):
    rng = random.Random(seed)
    vocabulary = sorted({w for t in SMALL for w in plain_words(t.text)})
    for n in (0, 1, 3, 8, 40, 400):
        text = random_text(rng, n)
        words = plain_words(text)
        sets = Sets(SMALL, {w: rng.randrange(5) for w in vocabulary})  # whatever the frequencies
        count, met = license_scan.places_of(text.encode(), frozenset(w.encode() for w in vocabulary))
        assert count == len(words)
        blocks = sets.blocks(count, met)
        for i, template in enumerate(SMALL):
            windows, room, size = plain_windows(words, template)
            mine = [(first, last, c) for k, first, last, c in blocks if k == i]
            for first, last, c in mine:
                assert (first, round(c * size)) in windows and last < first + room
            for a, n_shared in windows:  # each is over a block, which is no worse unless that is over a better one again
                assert any(first < a + room and last >= a for first, last, _ in mine)
            assert max([n for _, n in windows], default=0) == max([round(c * size) for *_, c in mine], default=0)


def test_best_of_a_family():
    rng = random.Random(9)
    sets = Sets(SMALL, {})
    for _ in range(30):
        text = random_text(rng, 120)
        n, met = license_scan.places_of(text.encode(), frozenset(w.encode() for t in SMALL for w in plain_words(t.text)))
        blocks = sets.blocks(n, met)
        kept = []
        for i, first, last, c in sorted(blocks, key=lambda b: (-b[3], -len(sets.ranks[b[0]]), SMALL[b[0]].label, b[1])):
            if not any(SMALL[i].family == f and first <= b and a <= last for f, _, a, b, _ in kept):
                kept.append((SMALL[i].family, SMALL[i].label, first, last, c))
        assert sorted(k[1:] for k in kept) == sorted(sets.labelled(blocks))


TEXTS = [
    None, "", " \n\t.,;", "Released under the MIT License.", "UNDER THE MIT\nLICENSE under-the-mit-license, under the mit, license", "cc by nc cc by nc", "CC BY-NC 4.0 and Apache License, Version 2.0",
    "K under the mit license Key İ", "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU Lesser General Public License", "a mite of licence; the general public; version 3 of the plan",
    "word " * 30_000 + TEMPLATES[0].text + " word" * 30_000, "x" * (1 << 21) + " under the mit license",
]


def test_scan_plainly(spark, monkeypatch):
    rng = random.Random(1)
    notice = TEMPLATES[0].text.split()
    for k in (5, 60):  # a few words changed, and too many
        for i in rng.sample(range(len(notice)), k):
            notice[i] = "zzz"
        TEXTS.append("before. " + " ".join(notice) + " after")
    rows = list(enumerate(TEXTS)) + [(None, "under the mit license"), (3, TEXTS[3]), (3, TEXTS[3])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("n_words", "places", "blocks", "labels", "word", "n", "a.b")}).repartition(3)
    got = {r.doc_id: r for r in license_scan.summarised(license_scan.scan(spark, frame)).collect()}
    assert license_scan.scan(spark, frame).count() == len(rows)
    for i, text in rows:
        words = plain_words(text)
        places = plain_places(words)
        r = got[i]
        assert r.n_words == len(words) and r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        if i is not None and len(words) < 1000:
            met = {t.label for t in TEMPLATES if plain_windows(words, t)[0]} | {label for _, label in places}
            families = {t.label: t.family for t in TEMPLATES}
            assert set(filter(None, r.labels.split(","))) <= met and {families[x] for x in filter(None, r.labels.split(","))} == {families[x] for x in met}
    assert [got[i].labels for i in (0, 1, 2, 10)] == [""] * 4 and got[0].score == 0.0
    assert got[8].labels == "gpl-3" and got[9].labels == "lgpl" and got[11].labels == "mit" and got[12].n_base == 1
    assert got[len(TEXTS) - 2].labels == "mit" and 0.8 <= got[len(TEXTS) - 2].score < 1 and got[len(TEXTS) - 1].labels == ""


def test_pieces_cut_no_word(monkeypatch):
    monkeypatch.setattr(license_scan, "PIECE", 7)
    for text in ("", "a", "under the mit license", "x" * 50, "under the mit license " * 5):
        assert [w for p in license_scan.pieces(text.encode()) for w in p] == text.encode().split()


def test_templates_are_checked(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert license_scan.scan(spark, none).collect() == []
    with pytest.raises(ValueError):
        license_scan.scan(spark, none, [Template("a", "a", " -- ")])
    with pytest.raises(ValueError):
        license_scan.scan(spark, none, phrases={"": "a"})


def test_query_over_the_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_licenses(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        places = plain_places(plain_words(texts[r.doc_id]))
        assert (r.n_words, r.n_base, r.base_labels) == (len(plain_words(texts[r.doc_id])), len(places), ",".join(sorted({x for _, x in places})))
        assert bool(r.labels) == ("licen" in (texts[r.doc_id] or "").lower() or bool(places))
