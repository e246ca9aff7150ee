"""Vector codes against a plain version in Python integers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import vector_codes
from brindle.llm.vector_codes import Settings

SCHEMA = "vec_id long, embedding array<double>, label int"


def plainly(rows, parts=8, entries=16, rounds=6):
    """Codes and errors of (key, vector, label), and the codebooks, one part after another."""
    kept = [(k, [math.floor(4096 * x) for x in v], g) for k, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = []
    for k in sorted({k for k, _, _ in kept}, key=lambda k: (k is None, k))[:entries]:
        first.append(min(v for key, v, _ in kept if key == k))
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def assign(p, part):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        chosen = [[assign(p, row[p])[0] for p in range(parts)] for row in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [row[p] for row, c in zip(cut, chosen, strict=True) if c[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out, by_label = [], {}
    for (k, _, g), row in zip(kept, cut, strict=True):
        found = [assign(p, row[p]) for p in range(parts)]
        out.append((k, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), g))
        by_label[g] = by_label.get(g, 0) + out[-1][2]
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((k, code, error, by_label[g]) for k, code, error, g in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def coded(spark, rows, schema=SCHEMA, **settings):
    found = vector_codes.compress(spark, spark.createDataFrame(rows, schema).repartition(3), Settings(**settings))
    return sorted((tuple(r) for r in found.rows.collect()), key=str), found.sha256


def made(n, seed, width=16, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.uniform(-spread, spread) for _ in range(width)], r.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("n", [5, 200])
def test_codes_plainly(spark, n):
    rows = made(n, n)
    assert coded(spark, rows) == plainly(rows)


def test_ties_and_repeated_rows(spark):
    """Few different small integers: many equal distances, entries that are equal, one vector a third of all."""
    r = random.Random(3)
    rows = [(i, [r.choice([-1, 0, 1]) / 4096 for _ in range(8)], 1) for i in range(60)]
    rows += [(100 + i, rows[7][1], None) for i in range(40)] + rows[:5]
    assert coded(spark, rows) == plainly(rows)


def test_left_out_rows_and_null_keys(spark):
    rows = made(30, 1)
    rows += [(-3, None, 1), (-2, [None] + [0.5] * 15, 1), (-1, [float("nan")] + [0.5] * 15, 0), (-4, [float("inf")] + [0.5] * 15, 0), (-5, [], 0), (-6, [0.5] * 8, 0), (None, [0.25] * 16, None)]
    kept = [x for x in rows if x[1] and len(x[1]) == 16]
    assert coded(spark, rows) == plainly(kept)
    few = [(None, [0.25] * 16, None), (4, [0.5] * 16, 2), (4, [0.125] * 16, 2)]
    assert coded(spark, few) == plainly(few)


def test_keys_that_repeat(spark):
    rows = [(i // 20, v, g) for i, v, g in made(400, 2)]
    assert coded(spark, rows) == plainly(rows)


def test_no_rows(spark):
    assert coded(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    assert coded(spark, [(1, None, 0)])[0] == []


def test_large_components_are_exact_or_refused(spark):
    rows = made(40, 5, spread=30_000.0)
    assert coded(spark, rows) == plainly(rows)
    with pytest.raises(ValueError, match="64 bits"):
        coded(spark, [(1, [1e30] * 16, 0)])
    with pytest.raises(ValueError, match="equal parts"):
        coded(spark, [(1, [0.5] * 12, 0)])


def test_clashing_names_small_blocks_and_files(spark):
    rows = made(50, 8)
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("k", "v", "p", "e", "code", "error", "label_error", "_label", "a.b")})
    found = vector_codes.compress(spark, wide, Settings(cells=48))
    assert (sorted((tuple(r) for r in found.rows.collect()), key=str), found.sha256) == plainly(rows)
    assert all(a >= b for a, b in zip(found.rounds, found.rounds[1:], strict=False)) and len(found.rounds) == 6
    root = vector_codes.write(found, spark)
    assert spark.read.parquet(f"{root}/codebooks").count() == 8 * 16 and spark.read.parquet(f"{root}/codes").count() == 50
