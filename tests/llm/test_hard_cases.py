"""Skew, clashing names, reruns, concurrent writers, and plain versions of what SQL can't say."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brindle.llm import exact_dedup, language_id, near_dedup, nearest, queries, secret_scan, sentencepiece_bpe, shard_store, source_mix, url_filter, warc
from brindle.llm.runtime import materialize, scratch

SF = "/root/testdata/sf0.001"
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with the names that operators use for themselves.
CLASHING = PLAIN + ", _file string, _row long, _metadata string, r string, _shard string, _copies int, `a.b` string, key string, node long, digest string, size int, h string"
TEST = secret_scan.TokenEfficiency(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "f", 7, "m", "r", "s", 3, "d", "k", 5, "g", 9, "h") for i, t, lang, s in rows], CLASHING)


@pytest.fixture(scope="module")
def skewed():
    """Half of all rows are one text, a quarter near copies of another."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(80)]
    rows = [(i, "one text of which there are very many copies", "en", "hot") for i in range(600)]
    for i in range(300):
        text = list(base)
        text[rng.randrange(80)] = word()
        rows.append((1000 + i, " ".join(text), "en", "hot"))
    rows += [(2000 + i, " ".join(word() for _ in range(30)), "en", rng.choice(["a", "", None])) for i in range(300)]
    return rows + [(None, None, None, None), (None, None, None, None), (5000, "", "en", ""), (2000, "same id, other text", "en", "a")]


def test_names_of_columns_may_clash(spark, skewed):
    frame = clashing(spark, skewed[::7] + skewed[-4:])
    for stage in (language_id.keep_identified, exact_dedup.keep_one, near_dedup.keep_one, source_mix.mixed_rows):
        for at in (frame, materialize(spark, frame, "clashing")):
            out = stage(spark, at)
            assert out.columns == frame.columns and out.count() > 0
    n = frame.count()
    for out in (exact_dedup.deduplicate(spark, frame), near_dedup.deduplicate(spark, frame), source_mix.mix(spark, frame), language_id.identify(spark, frame), secret_scan.scan(frame, TEST),
                sentencepiece_bpe.encode_digests(spark, frame, queries.PIECE_MODEL), shard_store.compacted(spark, frame, scratch(spark, "clash"))):
        assert out.count() == n
    vectors = spark.createDataFrame([(i, [1.0 + i, 2.0], "x", 1, 2) for i in range(30)], "vec_id long, embedding array<double>, v string, id int, length int")
    assert nearest.search(spark, vectors, F.col("id") == 0).count() == 20


def test_empty_tables(spark):
    none = clashing(spark, [])
    for out in (secret_scan.scan(none, TEST), sentencepiece_bpe.encode_digests(spark, none, queries.PIECE_MODEL), shard_store.compacted(spark, none, scratch(spark, "none")),
                *(stage(spark, none) for stage in (language_id.keep_identified, exact_dedup.keep_one, near_dedup.keep_one, source_mix.mixed_rows))):
        assert out.count() == 0


def test_hot_groups(spark, skewed):
    frame = spark.createDataFrame([(*r, None) for r in skewed], PLAIN).repartition(9)
    got = exact_dedup.deduplicate(spark, frame).collect()
    assert len(got) == len(skewed) and sum(r.kept for r in got) == len({re.sub(r"\s", "", t or "") for _, t, *_ in skewed})
    near = near_dedup.deduplicate(spark, frame).collect()
    assert Counter(r.component_id for r in near)[0] == 600 and Counter(r.component_id for r in near)[1000] == 300 and sum(r.component_id == r.doc_id for r in near if r.doc_id is not None) == 304
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", (t or "") * 9) for i, t, *_ in skewed], "page_id long, url string, html string").repartition(5)
    root = scratch(spark, "hot-warc")
    kinds = Counter(r.record_type for r in warc.read(spark, warc.write(spark, pages, root), root).collect())
    assert kinds == {"revisit": 599, "response": len(skewed) - 599}
    urls = [(i, "http://a.org/fr/x" if i % 3 else "http://b.net/y") for i in range(60)] + [(100 + i, "http://one.example/url") for i in range(500)]
    judged = url_filter.judge(spark, spark.createDataFrame(urls, "page_id long, url string"), queries.RULES).collect()
    assert len(judged) == 560 and len({r.score for r in judged if r.page_id >= 100}) == 1


def test_sources_null_and_empty(spark, skewed):
    rows = [(i, t, None, s, None) for i, t, _, s in skewed if i is not None and s in (None, "") and i != 2000]
    frame = spark.createDataFrame(rows, PLAIN)
    got = source_mix.mix(spark, frame)
    db = duckdb.connect()
    documents = frame.toPandas()  # noqa: F841  read by DuckDB
    want = db.sql(queries.MIX.replace("FROM documents", "FROM documents")).df()
    as_set = lambda f: sorted((int(r.doc_id), int(r.size_), int(r.source_size), round(r.target, 6), int(r.taken)) for r in f.rename(columns={"size": "size_"}).itertuples())
    assert as_set(got.toPandas()) == as_set(want)


def plain_mix(rows, order, settings):
    """(taken words per row): the schedule, walked slot by slot."""
    streams = {}
    for k, (_, text, _, source) in enumerate(rows):
        streams.setdefault(source, []).append(k)
    names = sorted(streams, key=lambda s: (s is None, s or ""))
    size = [len(re.findall(source_mix.WORD, r[1] or "")) for r in rows]
    total = {s: sum(size[k] for k in streams[s]) for s in names}
    left, open_, target = float(sum(total.values())), set(names), {}
    weight = {s: settings.weights[i % len(settings.weights)] for i, s in enumerate(names)}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > settings.repeats * total[s]}
        target |= {s: float(settings.repeats * total[s]) for s in full} if full else {s: level * weight[s] for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    block = max(1, min(settings.block, sum(total.values()) // (settings.blocks * len(names))))
    blocks = {s: max(1, total[s] // block) if total[s] else 0 for s in names}
    slots = {s: target[s] / (total[s] / blocks[s]) if blocks[s] else 0.0 for s in names}
    every, low, spans = sum(slots.values()), 0.0, []
    for s in names:
        if slots[s] > 0:
            spans.append((low, s))
            low += slots[s] / every
    nth, times = Counter(), Counter()
    for i in range(round(every)):
        u = (i + 1) * source_mix.GOLDEN
        s = max((x for x in spans if x[0] <= u - math.floor(u)), key=lambda x: x[0])[1]
        if nth[s] < blocks[s] * settings.repeats:
            times[s, nth[s] % blocks[s]] += 1
        nth[s] += 1
    taken = [0] * len(rows)
    for s in names:
        at = 0
        short, longer = divmod(total[s], blocks[s]) if blocks[s] else (0, 0)
        for k in sorted(streams[s], key=lambda k: order[k]):
            for word in range(at, at + size[k]):
                b = word // (short + 1) if word < longer * (short + 1) else longer + (word - longer * (short + 1)) // short
                taken[k] += times[s, b]
            at += size[k]
    return size, taken


def test_mix_is_the_schedule(spark, skewed):
    rows = [r for r in skewed if r[0] is not None]
    settings = source_mix.Settings(block=40, blocks=2)
    order = [(hashlib.md5(f"0:{i}".encode()).hexdigest(), i, len(re.findall(source_mix.WORD, t or ""))) for i, t, *_ in rows]
    size, taken = plain_mix(rows, order, settings)
    got = source_mix.mix(spark, spark.createDataFrame([(*r, None) for r in rows], PLAIN), settings).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter(zip((r[0] for r in rows), size, taken, strict=True))


def test_pipeline_twice_and_plainly(spark):
    """Two runs over the same rows, stored differently, agree; each stage is what a plain version makes of its input."""
    import sentencepiece

    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    runs = []
    for parts in (3, 7):
        at, kept = materialize(spark, table.repartition(parts), "again"), []
        for name, stage in corpus_pipeline.STAGES:
            at = materialize(spark, stage(spark, at, SF), f"again-{name}")
            kept.append(at.collect())
        runs.append(kept)
    for a, b in zip(*runs, strict=True):
        assert Counter(a) == Counter(b)
    language, exact, near, mixed, encoded = runs[0]
    model = language_id.fit(spark, table)
    assert Counter(language) == Counter(r for r in table.collect() if not model.judge(r.text)[2])
    best = {}
    for r in language:
        best.setdefault(re.sub(r"[ \t-\r]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id, r))
    assert Counter(exact) == Counter(min(v)[2] for v in best.values())
    words = [re.findall(source_mix.WORD, "".join(c.lower() if c < "\x80" else c for c in r.text or "")) for r in exact]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    label = list(range(len(exact)))
    for i in range(len(exact)):
        for j in range(i):
            if sets[i] and sets[j] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    stays = {}
    for k, r in zip(label, exact, strict=True):
        stays[k] = min(stays.get(k, r), r, key=lambda x: x.doc_id)
    assert Counter(near) == Counter(stays.values())
    digest = spark.createDataFrame(near, table.schema).select("doc_id", F.xxhash64(*table.columns).alias("all")).collect()
    of = {r.doc_id: r["all"] for r in digest}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in near]
    order = [hashlib.md5(f"0:{r.doc_id}:{hashlib.sha256((r.text or '').encode()).hexdigest()}:{of[r.doc_id]}".encode()).hexdigest() for r in near]
    size, taken = plain_mix(rows, order, source_mix.Settings())
    want = Counter()
    for r, n, t in zip(near, size, taken, strict=True):
        want[r] += math.floor(t / max(1, n) + 0.5)
    assert Counter(mixed) == +want
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    ids = Counter((r.doc_id, hashlib.sha256(",".join(map(str, library.encode(r.text or ""))).encode()).hexdigest()) for r in mixed)
    assert Counter((r.doc_id, r.ids_sha256) for r in encoded) == ids


def test_language_plainly(spark):
    """TF-IDF, centroids and scores computed with dictionaries of n-grams."""
    rng = random.Random(6)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(rng.randint(5, 40)))
    rows = [(i, make("abcdeé" if i % 2 else "cdefgh"), "x" if i % 2 else "y", None) for i in range(80)] + [(200 + i, make("abcdefgh ,.1"), None, None) for i in range(20)]
    settings = language_id.Settings(dimensions=1 << 12)
    got = {r.doc_id: r for r in language_id.identify(spark, spark.createDataFrame([(*r, None) for r in rows], PLAIN), settings).collect()}
    mask, shift = (1 << 32) - 1, 32 - 12

    def grams(text):
        s = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
        out = Counter()
        for n in range(1, settings.orders + 1):
            for k in range(len(s) - n + 1):
                g = 0
                for c in s[k : k + n]:
                    g = (g * 0x9E3779B1 + ord(c) + 1) & mask
                out[(g * 0x85EBCA6B & mask) >> shift] += 1
        return out

    taught = [(lang, i, grams(t)) for i, t, lang, _ in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    taught.sort(key=lambda r: (r[0], str(r[1])))
    df = Counter(g for *_, c in taught for g in c)
    idf = lambda g: math.log((1 + len(taught)) / (1 + df[g])) + 1

    def vector(c):
        v = {g: (1 + math.log(n)) * idf(g) for g, n in c.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / length for g, x in v.items()}

    def mean(vs):
        out = Counter()
        for v in vs:
            for g, x in v.items():
                out[g] += x
        length = math.sqrt(sum(x * x for x in out.values())) or 1.0
        return {g: x / length for g, x in out.items()}

    dot = lambda a, b: sum(x * b.get(g, 0.0) for g, x in a.items())
    centroids = []
    for lang in ("x", "y"):
        own = [vector(c) for name, _, c in taught if name == lang]
        middle = mean(own)
        c = [max(own, key=lambda v: dot(v, middle))]
        while len(c) < settings.centroids:
            c.append(min(own, key=lambda v: max(dot(v, x) for x in c)))
        for _ in range(settings.iterations):
            members = [max(range(len(c)), key=lambda j: dot(v, c[j])) for v in own]
            c = [mean([v for v, m in zip(own, members, strict=True) if m == j]) if j in members else c[j] for j in range(len(c))]
        centroids += [(lang, x) for x in c]
    for i, text, *_ in rows:
        v = vector(grams(text))
        best = max(centroids, key=lambda x: dot(v, x[1]))
        assert abs(got[i].score - dot(v, best[1])) < 1e-4
        assert got[i].lang_pred == best[0] or abs(dot(v, best[1]) - max(dot(v, x) for n, x in centroids if n == got[i].lang_pred)) < 1e-4


def test_language_of_a_row_repeated_without_end(spark):
    """A row that repeats neither fills the sample nor comes to the driver more than once."""
    rows = [(1, "der die das und nicht", "de", None)] * 3000 + [(i, f"the and of to in number{i}", "en", None) for i in range(2, 40)] + [(100 + i, f"wort und satz {i}", "de", None) for i in range(30)]
    model = language_id.fit(spark, spark.createDataFrame([(*r, None) for r in rows], PLAIN), language_id.Settings(sample=10))
    assert set(model.languages) == {"de", "en"} and model.judge("wort und satz")[0] == "de"


#: Runs that known digests and identifiers, dates and versions make up but for words.
KNOWN_RUNS = (
    "urn-123e4567-e89b-12d3-a456-426614174000", "img_123E4567-e89b-12d3-a456-426614174000_v2", "commit/da39a3ee5e6b4b0d3255bfef95601890afd80709/files",
    "sha256-e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "sha512-" + "cf83e1357eefb8bd" * 8, "2026-11-28T10-20-30-123456", "v1_2_3-alpha-build-20261128",
    "D41D8CD98F00B204E9800998ECF8427E/backup_2026-11-28", "550e8400-e29b-41d4-a716-446655440000/d41d8cd98f00b204e9800998ecf8427e", "releases/2024-01-02T03-04-05Z/notes",
)


def test_known_forms_in_runs_are_no_secrets():
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for run in KNOWN_RUNS:
        text = f"see {run} and (http://x.org/{run}?q)"
        assert secret_scan.random_spans(text, TEST, []) == [], run
        for n in (20, 32, 48):  # a key beside a known form is one still
            key = "x" + "".join(rng.choices(letters, k=n - 2)) + "Q"
            for text, at in ((f"a {key}/{run} b", 2), (f"a {run}-{key} b", 3 + len(run))):
                spans = secret_scan.random_spans(text, TEST, [])
                met = sum(max(0, min(b, at + n) - max(a, at)) for a, b, _ in spans)
                assert met >= 0.8 * n, (text, spans)


def plain_random_spans(text, test):
    """The method's definition followed literally: every run, stretch, part and window tried for itself."""
    import tiktoken

    with open(test.rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("plain", pat_str=test.pattern, mergeable_ranks=ranks, special_tokens={})
    cost = lambda s: sum(len(own.encode_ordinary(s[i : i + test.window])) for i in range(0, len(s), test.window))
    uuid = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
    digests = "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in (32, 40, 48, 56, 64, 96, 128))
    found = set()
    for run in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(run[0]) < 20 or run[0].isdigit():
            continue
        cuts = []
        for m in re.finditer(rf"(?<![A-Za-z0-9])(?:{uuid}|{digests}|([vV]?[0-9]+(?:[-_/+=T]+[0-9]+)*Z?))(?![A-Za-z0-9])", run[0]):
            if m[1] is None or re.search("[0-9]{4}|[0-9][^0-9]+[0-9]", m[1]):
                cuts.append(m.span())
        at = 0
        for a, b in [*cuts, (len(run[0]), None)]:
            i, j = at, a
            while i and i < j and not run[0][i].isalnum():
                i += 1
            while b is not None and i < j and not run[0][j - 1].isalnum():
                j -= 1
            at = b
            if j - i < 20:
                continue
            stretch = run[0][i:j]
            place = run.start() + i
            wordy = secret_scan.WORDS.fullmatch(stretch) or not re.search("[0-9]", stretch) or not re.search("[A-Za-z]", stretch)
            if not wordy and len(stretch) / cost(stretch) < test.chars_per_token:
                found.update(range(place, place + len(stretch)))
                continue
            tokens = []
            for part in re.finditer("[A-Za-z0-9]+", stretch):
                if len(part[0]) >= 20 and len(part[0]) / cost(part[0]) < test.chars_per_token:
                    found.update(range(place + part.start(), place + part.end()))
                p = part.start()
                for k in range(0, len(part[0]), test.window):
                    for t in own.encode_ordinary(part[0][k : k + test.window]):
                        n = len(own.decode_single_token_bytes(t))
                        tokens.append((p, p + n))
                        p += n
            for least in test.windows:
                for x in range(len(tokens)):
                    y, chars = x, 0
                    while y < len(tokens) and chars < least:
                        chars += tokens[y][1] - tokens[y][0]
                        y += 1
                    span = tokens[y - 1][1] - tokens[x][0]
                    if chars >= least and chars / (y - x) < test.chars_per_token and (span - chars) / span <= test.joints:
                        found.update(range(place + tokens[x][0], place + tokens[y - 1][1]))
    return found


def test_random_spans_plainly():
    """What is covered by random spans, against a version that shares no code with them but the list of words."""
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pieces = [*KNOWN_RUNS, "internationalization", "src/main/java", "MAX_BUFFER", "a", "v2", "12", "2026", "-", "_", "==", "configuration", "getElements"]
    covered = 0
    for _ in range(300):
        made = [rng.choice(pieces) if rng.random() < 0.7 else "".join(rng.choices(letters, k=rng.choice([5, 12, 20, 33, 70]))) for _ in range(rng.randint(1, 7))]
        text = "".join(p + rng.choice(["/", "-", "_", " ", "+", ""]) for p in made)
        got = {i for a, b, _ in secret_scan.random_spans(text, TEST, []) for i in range(a, b)}
        assert got == plain_random_spans(text, TEST), text
        covered += len(got)
    assert covered > 3000


def test_secret_spans_in_base_spans():
    """Spans inside base ones are left out, however many there are."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("0123456789abcdef", k=rng.choice([24, 30, 41]))) + " " + "".join(rng.choices("ABCDEFGHabcdefgh0123456789", k=rng.choice([21, 30]))) for _ in range(400))
    base = secret_scan.base_spans(text)
    got = secret_scan.random_spans(text, TEST, base)
    want = [w for w in secret_scan.random_spans(text, TEST, []) if not any(s <= w[0] and w[1] <= e for s, e, _ in base)]
    assert got == want and len(got) > 100 and len(base) >= 400


def test_store_of_many_writers(spark):
    frame = spark.createDataFrame([(i, "t" * (i % 50), None, "s", i) for i in range(400)], PLAIN)
    at = scratch(spark, "writers")
    one, two = (shard_store.ShardStore(spark, at, shard_store.Settings(arrival_rows=20, target=20_000, lowest=2_000)) for _ in range(2))
    one.append(frame)
    taken, commit = [], one.commit

    def later(before, shards, schema):  # another writer commits just before, once
        if not taken:
            taken.append(two.append(frame.limit(40)).version)
        return commit(before, shards, schema)

    one.commit = later
    one.append(frame.limit(7))
    assert taken == [2] and one.read().count() == 447
    taken.clear()
    last = one.compact()
    assert taken and one.read().count() == 487 == sum(s.rows for s in last.shards)
    assert [one.read(v).count() for v in range(5)] == [0, 400, 440, 447, 487], "earlier versions stay readable"
    orphans = one._write(frame.limit(3))
    assert one.sweep(1, 3600.0) == 0 and one.versions() == [last.version]
    assert one.sweep(1, 0.0) >= len(orphans) and one.sweep(1, 0.0) == 0
    assert sorted(r.doc_id for r in one.read().collect()) == sorted([*range(400), *(r.doc_id for r in frame.limit(40).collect()), *(r.doc_id for r in frame.limit(7).collect()), *(r.doc_id for r in frame.limit(40).collect())])


def test_nearest_looks_at_little(spark):
    """The larger the table, the smaller the part of it that is compared, at the same recall."""
    rng, share = np.random.default_rng(8), []
    for n in (1000, 8000):
        x = rng.normal(size=(n, 16)).astype(np.float32).astype(np.float64)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        asked = rows.where("id % 50 = 0")
        length = np.linalg.norm(x, axis=1)
        shape = nearest.tuned(spark, rows, asked, nearest.Shape(16, length.max(), True, n), nearest.Settings())
        own = nearest.Hashes(shape, nearest.Settings())
        unit, q = own.unit(x, False), own.unit(x[::50], True)
        looked = np.zeros((len(q), n), bool)
        for t in range(nearest.Settings().tables):
            first, rest = own.buckets(unit, t)
            wanted, others = own.probed(q, t)
            for i in range(len(q)):
                looked[i] |= np.isin(first * 10**9 + rest, wanted[i] * 10**9 + others[i])
        score = x[::50] @ x.T
        score[np.arange(len(q)), np.arange(0, n, 50)] = -np.inf
        best = np.argsort(-score, axis=1)[:, :20]
        assert looked[np.arange(len(q))[:, None], best].mean() >= 0.9
        share.append(looked.mean())
    assert share[1] < 0.8 * share[0] and share[1] < 0.25, share


def test_rotations_of_narrow_vectors():
    """The matrix of a pseudo-rotation does what its rounds do."""
    x = np.random.default_rng(1).normal(size=(50, 32))
    shape = nearest.Shape(32, 1.0, False, 50, 2, 8)
    a, b = nearest.Hashes(shape, nearest.Settings()), nearest.Hashes(shape, nearest.Settings(narrow=0))
    assert b.narrow is None and all(np.allclose(a.rotated(x, t, k), b.rotated(x, t, k)) for t in range(3) for k in range(2))


@pytest.mark.parametrize("settings", [near_dedup.Settings(), near_dedup.STANDARD])
def test_near_pairs_share_a_bucket_at_any_size(settings):
    """The least similar pairs that are links, small sets (whose bins borrow much) as well as large ones."""
    own, rng = near_dedup.Hasher(settings), np.random.default_rng(2)
    for n in (4, 7, 10, 20, 50, 200):
        found = [(i / (n + m - i), m, i) for m in range(n, 2 * n) for i in range(1, n + 1) if 100 * i >= settings.percent * (n + m - i)]
        _, m, i = min(found)
        for _ in range(200):
            x = rng.integers(0, 1 << 63, n + m - i, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:i], x[n:]]))
            assert np.intersect1d(own.buckets(a), own.buckets(b)).size
