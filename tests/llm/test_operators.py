"""Operators of the llm subpackage against plain Python over small hard tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brindle.llm import exact_dedup, language_id, near_dedup, nearest, queries, secret_scan, sentencepiece_bpe, shard_store, source_mix, url_filter, warc
from brindle.llm.runtime import scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, kept boolean, lang_pred string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", None, "z") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeionrstlé") for _ in range(rng.randint(1, 9)))
    base = [word() for _ in range(60)]
    rows = [(0, None, "en", "a"), (1, "", "en", None), (2, " \t\n", None, "b"), (3, "1 2 3", "en", "a"), (4, "one", "en", "a"), (5, "one two", "en", "b"), (6, "ONE  two", "en", "b"), (7, "x" * 40_000, "fr", "c"), (8, " ".join(word() for _ in range(20_000)), "fr", "c")]
    for k in range(40):  # near copies of one text, of many degrees
        text = list(base)
        for _ in range(k // 4):
            text[rng.randrange(60)] = word()
        rows.append((100 + k, " ".join(text), "en", "hot"))
    rows += [(200 + k, " ".join(base), "en", "hot") for k in range(10)]
    rows += [(300 + k, " ".join(word() for _ in range(rng.randint(1, 200))), rng.choice(["en", "fr"]), rng.choice("abc")) for k in range(60)]
    return rows + [(None, "null key", "en", "a"), (310, "repeated id", "en", "a"), (310, "repeated id", "en", "a")]


def test_secrets(spark, hard):
    test = secret_scan.TokenEfficiency(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ['é API_key = "abcdef123" token:short ſecret=abcdefgh', "AKIA" + "Z9" * 8 + " " + "0f" * 12 + " AKIA12", "password='aaaaaa' passwd=bbbbbbb secret : cccccc", "see qZ7xKp2LmV9tRw4BnY8s and d41d8cd98f00b204e9800998ecf8427e and 123e4567-e89b-12d3-a456-426614174000"]
    rows = [*hard, *((900 + i, t, None, None) for i, t in enumerate(texts))]
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, rows), test).collect() if r.doc_id is not None}
    assert len(got) == len({r[0] for r in rows if r[0] is not None})
    kinds = ("assign", "access", "hex")
    patterns = (r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    for i, text, *_ in rows:
        if i is None:
            continue
        spans = []
        for kind, pattern, good in zip(kinds, patterns, (lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24), strict=True):
            spans += [(m.start(), kinds.index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if good(m)]
        base = ",".join(s[2] for s in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
    assert got[903].n_random == 1 and got[903].spans.startswith("random:4:24")


def test_secrets_of_letters_and_within_runs():
    test = secret_scan.TokenEfficiency(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    found = lambda text: [(a, b) for a, b, _ in secret_scan.random_spans(text, test, [])]
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters in (lower, upper, lower + upper):
        for _ in range(50):
            assert found("see " + "".join(rng.choices(letters, k=32)) + " here") == [(4, 36)]
    for path in ("internal/services/authentication/production/credentials/", "internal/services/production-credentials/rotation/", "word" * 1050):
        for n, letters in ((20, lower + upper + "0123456789"), (60, lower + upper + "0123456789+/")):
            key = "x" + "".join(rng.choices(letters, k=n - 2)) + "Q"
            spans = found(path + key)
            assert sum(max(0, min(b, len(path) + n) - max(a, len(path))) for a, b in spans) >= 0.8 * n
            assert n == 60 and spans == [(0, len(path) + n)] or all(a >= len(path) - 64 for a, _ in spans)  # the whole run, or about the key
    for plain in ("internationalization", "MAX_BUFFER_SIZE_LIMIT", "DEFAULT_CONNECTION_TIMEOUT_SECONDS", "getElementsByTagNameNS", "how-to-go-to-an-in-on-of-it", "src/main/java/com/example/app", "docs/internationalization/sources/d41d8cd98f00b204e9800998ecf8427e", "downloads/internationalization/123e4567-e89b-12d3-a456-426614174000", "-" * 40):
        assert found(plain) == [], plain


def test_url_rules_and_model(spark):
    rng = random.Random(1)
    urls = [f"http://{'ads-' if bad else ''}{rng.choice(['news', 'shop'])}.example.{'net' if bad else 'org'}/{'xx' if bad else 'fr'}/{rng.randint(0, 999)}" for bad in rng.choices([True, False], k=400)]
    hard = [None, "", "no scheme", "http://", "http://NET", "http://net/", "HTTP://Éx.ORG/fr/a?b#c", "a://b.net?x/", "ftp://example.net/en/x", "x://my.example.com/de/", "x://example.com/dex", "://net/#/", "http://ads-news.example.info/xx/7", "http://news.example.info/fr/7", "http://" + "a" * 5000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + hard)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(spark, pages, queries.RULES).collect()}
    assert len(got) == len(urls + hard)
    for i, u in enumerate(urls + hard):
        _, found, rest = (u or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if found else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if found else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name)
        assert got[i].verdict == (rule.verdict if rule else got[i].verdict)
    assert got[len(urls)].verdict == "allow"  # a null URL
    asked = urls + ["http://ads-news.example.info/xx/7", "http://news.example.info/fr/7"]
    model = url_filter.judge(spark, spark.createDataFrame(list(enumerate(asked)), "page_id long, url string"), queries.RULES).where("rule IS NULL")
    assert [r.verdict for r in model.orderBy("page_id").collect()] == ["block", "allow"]
    assert url_filter.judge(spark, pages.limit(0), queries.RULES).count() == 0


def test_url_model_is_interpolation(spark):
    """The table's sums are the smoothed probabilities, computed plainly."""
    import math

    settings = url_filter.Settings(order=2, least=1, calibrate=10**9)
    rows = [("abab", True), ("abac", True), ("a\0b\n", True), ("bbbb", False), ("babc", False), ("b\0\0\n\nc", False)]
    model, _ = url_filter.fit(spark, spark.createDataFrame(rows, "url string, accepted boolean"), settings)
    asked = ["abab", "cabz", "", "a\0b", "\n\nb\0\n", "\0"]
    own = lambda t: "\n\n" + t.replace("\0", "\ufffd").replace("\n", "\ufffd") + "\n"
    got = {r.url: r.score for r in url_filter.scored(spark.createDataFrame([(u,) for u in asked], "url string"), model, settings, ["url"]).collect()}

    def p(x, c, texts):
        lower = p(x[1:], c, texts) if x else 1 / settings.alphabet
        after = [t[i + len(x)] for t in texts for i in range(len(t) - len(x)) if t[i : i + len(x)] == x and i + len(x) >= 2]
        return (after.count(c) + len(set(after)) * lower) / (len(after) + len(set(after))) if after else lower

    for u in asked:
        full = own(u)
        sides = [[own(t) for t, a in rows if a is side] for side in (True, False)]
        want = [math.log(p(full[i - 2 : i], full[i], sides[0]) / p(full[i - 2 : i], full[i], sides[1])) for i in range(2, len(full))]
        assert abs(got[u] - sum(want) / len(want)) < 1e-9


def test_url_model_has_all_urls_and_entries(spark):
    """What was counted is in the model, whatever its size; settings that bound it, if there are any, are exceeded."""
    bounds = {k: 50 for k in ("sample", "entries") if hasattr(url_filter.Settings, k)}
    settings = url_filter.Settings(order=2, least=1, calibrate=10**9, **bounds)
    rng = random.Random(3)
    rows = [("".join(rng.choices("abcdefgh", k=20)), i % 2 == 0) for i in range(300)]
    model, _ = url_filter.fit(spark, spark.createDataFrame(rows, "url string, accepted boolean"), settings)
    full = ["\n\n" + u + "\n" for u, _ in rows]
    seen = {t[i - k : i + 1] for t in full for i in range(2, len(t)) for k in range(3)}
    got = [r.g for r in model.collect()]
    assert Counter(got) == Counter([*seen, *{g[:-1] + "\0" for g in seen}])


def test_exact_dedup(spark, hard):
    got = exact_dedup.deduplicate(spark, docs(spark, hard)).collect()
    assert len(got) == len(hard)
    groups = {}
    for i, text, *_ in hard:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    by_text = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    assert all((r.keep_id, r.group_size) == by_text[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.keep_one(spark, docs(spark, hard))
    assert kept.count() == len(groups) and kept.columns == docs(spark, []).columns
    assert exact_dedup.deduplicate(spark, docs(spark, [])).count() == 0


def test_dedup_stream_goes_on(spark):
    """A later call takes only new files, and the state spans both."""
    came, state = scratch(spark, "came"), scratch(spark, "state")
    rows = docs(spark, [(5, "a b", None, None), (9, "ab", None, None)]).select("*", F.lit("f").alias("_file"), F.lit(0).cast("long").alias("_row"))
    first = exact_dedup.arrivals(rows)
    first.coalesce(1).write.parquet(came)
    one = exact_dedup.run_stream(spark, came, first.schema, state, exact_dedup.Settings(files_per_batch=1)).collect()
    exact_dedup.arrivals(rows.withColumn("doc_id", F.col("doc_id") - 4)).repartition(2).write.mode("append").parquet(came)
    two = exact_dedup.run_stream(spark, came, first.schema, state, exact_dedup.Settings(files_per_batch=1)).collect()
    assert [(r["first"].key, r["size"]) for r in one + two] == [(5, 2), (1, 4)]


def test_sentencepiece(spark, hard):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    rows = [*hard, (901, "  two  ▁ spaces \n\n", None, None), (902, "日本 😀\x00<s>", None, None), (903, "a" * 3000, None, None)]
    got = sentencepiece_bpe.encode_digests(spark, docs(spark, rows), queries.PIECE_MODEL).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = model.encode(text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    ids = sentencepiece_bpe.encode(docs(spark, rows[-3:]), queries.PIECE_MODEL).collect()
    assert [r.ids for r in ids] == [model.encode(r[1]) for r in rows[-3:]]


def test_sentencepiece_fuzz():
    import sentencepiece

    model, ours = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL), sentencepiece_bpe.Backtracker(queries.PIECE_MODEL)
    rng, parts = random.Random(2), ["a", "the", "ing", " ", "  ", "▁", "\n", "é", "中", "😀", "ß", "23", "...", " " * 17, "th", "https", "://", "_", "{", "�", "한"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        ids = model.encode(text)
        assert ours.encode(text) == ids and ours.decode(ids) == model.decode(ids) == ours.round_trip(text)[1]


def brute_components(rows, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append(frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for k, (i, *_) in zip(label, rows, strict=True):
        least[k] = min(least.get(k, (True, 0)), (i is None, i or 0))
    return sets, [None if least[k][0] else least[k][1] for k in label], label


def test_near_dedup(spark, hard):
    sets, component, _ = brute_components(hard, 3, 85)
    want = Counter((i, len(s), c, i == c) for (i, *_), s, c in zip(hard, sets, component, strict=True))
    got = near_dedup.deduplicate(spark, docs(spark, hard)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert near_dedup.deduplicate(spark, docs(spark, [])).count() == 0


def test_near_dedup_keeps_one(spark, hard):
    sets, _, label = brute_components(hard, 5, 80)
    kept = near_dedup.keep_one(spark, docs(spark, hard))
    wordless = sum(not s for s in sets)
    assert kept.count() == len({c for s, c in zip(sets, label, strict=True) if s}) + wordless
    assert kept.columns == docs(spark, []).columns


def test_near_dedup_links_past_the_centre(spark):
    """Chains whose ends are unlike, and variants that are alike but unlike their buckets' centres."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows, text = [], list(words)
    for k in range(30):
        rows.append((k, " ".join(text), None, None))
        text = list(text)
        text[rng.randrange(120)] = f"c{k}"
    for k in range(60):
        text = list(words)
        for _ in range(rng.randint(3, 9)):
            text[rng.randrange(120)] = f"v{rng.randrange(12)}"
        rows.append((100 + k, " ".join(text), None, None))
    _, component, _ = brute_components(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.deduplicate(spark, docs(spark, rows)).collect()}
    assert got == {i: c for (i, *_), c in zip(rows, component, strict=True)}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 2000 + i) for i in range(100)]
    label = {x: x for p in pairs for x in p}
    for a, b in pairs * 2:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {k: new if v == old else v for k, v in label.items()}
    got = {r.node: r.component for r in near_dedup.components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    alone = {a for a, b in pairs if a == b}
    assert {k: v for k, v in label.items() if k not in alone or k in got} == got


@pytest.mark.parametrize("lengths", [False, True])
def test_nearest(spark, lengths):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if lengths:
        x *= rng.uniform(0.2, 3, (700, 1))
    x[300:400] = x[299]  # one vector many times
    x = x.astype(np.float32).astype(np.float64)
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + 20 * i, v) for i, v in enumerate(bad)] + [(None, [1.0] * 24)]
    got = nearest.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).collect()
    assert Counter(r.query_id for r in got) == {i: 20 for i in range(0, 700, 20)}
    hits = 0
    for q in range(0, 700, 20):
        score = x @ x[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-score[i], i))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        assert all(a.score > b.score or a.score == b.score and a.vec_id < b.vec_id for a, b in zip(mine, mine[1:], strict=False))
        hits += len({r.vec_id for r in mine} & set(best))
    assert hits >= 0.9 * 35 * 20


def test_nearest_of_few(spark):
    rows = [(i, [float(i == k) + 0.1 for k in range(8)]) for i in range(5)]
    got = nearest.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, i, i) for i in range(1, 5)]
    assert nearest.search(spark, spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_nearest_recall_at_any_size(spark):
    """A bound on the vectors of one hash, where the settings have one, is exceeded."""
    bound = {"vectors_per_hash": 2000} if hasattr(nearest.Settings, "vectors_per_hash") else {}
    x = np.random.default_rng(6).normal(size=(3000, 32)).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = Counter()
    for r in nearest.search(spark, rows, F.col("id") % 100 == 0, nearest.Settings(**bound)).collect():
        score = x @ x[r.query_id]
        got[r.query_id] += r.vec_id in np.argsort(-score)[1:21]
    assert len(got) == 30 and sum(got.values()) >= 0.9 * 30 * 20


def test_nearest_of_repeated_rows(spark):
    """A row that repeats does not crowd out others with its vector."""
    near, far = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, near)] * 30 + [(i, near) for i in range(2, 6)] + [(0, near)] + [(i, far) for i in range(21, 60)]
    got = nearest.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5, *range(21, 36)]


def test_hadamard():
    h = nearest.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def fill(sizes, weights, repeats):
    """Targets by pouring: share what is left among the open until none is above its limit."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > repeats * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: float(repeats * sizes[s]) for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def test_mix(spark, hard):
    rows = [*hard, *((1000 + i, "tiny words", None, "small") for i in range(3)), *((2000 + i, "w " * 50, None, f"s{i % 7}") for i in range(400))]
    frame = docs(spark, rows)
    got = source_mix.mix(spark, frame).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, text, _, s in rows:
        size[s] += len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = fill(size, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    times = Counter(i for i, *_ in rows)
    of = {i: s for i, _, _, s in rows}
    texts = {i: t for i, t, *_ in rows}
    taken = Counter()
    for r in got:
        s = of[r.doc_id]
        if times[r.doc_id] > 1:
            s = next(s for s in size if size[s] == r.source_size)
        else:
            assert (r["size"], r.source_size) == (len(WORD.findall(texts[r.doc_id] or "")), size[s])
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 4 for s in want)
    again = source_mix.mix(spark, frame.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert source_mix.mix(spark, docs(spark, [])).count() == 0
    mixed = source_mix.mixed_rows(spark, frame)
    assert mixed.columns == frame.columns
    assert abs(mixed.where("source = 'hot'").count() / sum(s == "hot" for *_, s in rows) - taken["hot"] / size["hot"]) < 0.1


def test_language(spark, hard):
    got = language_id.identify(spark, docs(spark, hard)).collect()
    assert len(got) == len(hard)
    for r in got:
        text = next(t for i, t, *_ in hard if i == r.doc_id)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and r.lang_pred in ("und", "en", "fr")
    kept = language_id.keep_identified(spark, docs(spark, hard))
    assert kept.columns == docs(spark, []).columns and {0, 1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_id.identify(spark, docs(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.identify(spark, docs(spark, [(1, "abc", None, None)])).collect()} == {"und"}


def test_language_learns_every_label(spark):
    """Also more of them than a model ever had."""
    rng = random.Random(9)
    words = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30))
    rows = [(i, words(), f"l{i:03}", "s") for i in range(400)]
    learned = {lang: t for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    model = language_id.fit(spark, docs(spark, rows))
    assert len(learned) > 200 and set(model.languages) == set(learned)
    assert all(model.judge(t)[::2] == (lang, False) for lang, t in learned.items())


def test_language_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(spark, table).join(table.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and not any(r.rejected for r in rows)


def test_warc(spark):
    rng = random.Random(8)
    bodies = ["".join(rng.choice("<p>abc é") for _ in range(rng.randint(90, 900))) for _ in range(60)]
    rows = [(i, f"http://x/{i}\r\nEvil: 1", bodies[i % 45]) for i in range(120)] + [(500, None, None), (501, "u", ""), (502, "u", "short"), (503, "u", "short"), (504, "u", bodies[0]), (505, "u", "long " * 30_000), (None, "u", bodies[1]), (506, "http://e", "\r\n\r\nWARC/1.1 " * 30)]
    root = scratch(spark, "warc")
    settings = warc.Settings(archive=4000)
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write(spark, pages, root, settings)
    got = {r.page_id: r for r in warc.read(spark, archives, root).collect()}
    assert len(got) == len(rows) and archives.count() > 3
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        refers = min(same) if len(raw) >= 100 and i != min(same) else None
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers is not None else "response", refers)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    fields, block = warc.parse(next(r for a in archives.collect() for r in warc.records(root, a.archive) if b"<urn:x-page:500>" in r))
    assert fields["warc-type"] == "response" and "evil" not in fields and block.endswith(b"\r\n\r\n")
    empty = warc.write(spark, pages.limit(0), scratch(spark, "none"))
    assert warc.read(spark, empty, root).count() == 0


def test_shards(spark, hard):
    frame = docs(spark, hard)
    store = shard_store.ShardStore(spark, scratch(spark, "store"), shard_store.Settings(arrival_rows=7, target=30_000, lowest=4_000))
    first = store.append(frame.repartition(2))
    store.append(frame.limit(20))
    before = store.read(1).drop("_shard")
    assert before.exceptAll(frame).isEmpty() and before.count() == len(hard)
    last = store.compact()
    rows = store.read().drop("_shard")
    assert rows.count() == len(hard) + 20 == sum(s.rows for s in last.shards) and rows.subtract(frame).isEmpty()
    assert len(last.shards) < len(first.shards) and not store.runs(last.shards)
    with pytest.raises(shard_store.CommitConflict):
        store.commit(first, [], None)
    with pytest.raises(ValueError):
        store.append(frame.drop("lang"))
    other = shard_store.ShardStore(spark, scratch(spark, "empty"))
    other.append(frame.limit(0))
    assert other.compact().shards == () and other.read().count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries(), key=lambda n: int(re.search(r"\d+", n)[0])))
def test_query_runs(spark, name):
    frame = queries.queries()[name](spark, SF)
    rows = {"op1_warc": "pages", "op3_url_filter": "pages"}.get(name, "documents")
    n = frame.count()
    assert n == (20 * sum(r.vec_id % 20 == 0 for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()) if name == "op7_nearest" else spark.read.parquet(f"{SF}/{rows}.parquet").count())


def test_pipeline(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    at = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == table.columns and at.count() > 0
    assert {"doc_id", "n_tokens"} <= set(corpus_pipeline.run(spark, SF).columns)
