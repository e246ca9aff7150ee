"""Packing against a plain fold."""

import random

from brindle.operators import packing


def plain(rows, header, budget, reserve):
    used, kept = header, {}
    for pos, id_, size, seed, free, needs in sorted(rows):
        cost = -(-(used + size) // 3)
        if seed and budget - reserve < cost <= budget:
            reserve = 0
        if cost <= (budget if free else budget - reserve) and (needs is None or kept.get(needs)):
            used += size
            kept[id_] = True
    return kept


def test_free_and_needing_sections(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [(i, f"s{i}", rng.randint(1, 200), rng.random() < 0.2, False, None) for i in range(30)]
        rows += [(100 + i, f"n{i}", rng.randint(1, 120), False, True, rng.choice([None, f"s{rng.randrange(30)}"])) for i in range(10)]
        frame = spark.createDataFrame(rows, "pos long, id string, bytes long, seed boolean, free boolean, needs string")
        got = {r.id for r in packing.pack(frame, 50, 700, 150).collect() if r.kept}
        assert got == set(plain(rows, 50, 700, 150))
