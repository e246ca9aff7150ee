"""Blocks against the standard library's matcher, and times on repeated lines."""

import difflib
import random
import time

from brindle.functions import line_match


def plainly(old, new):
    return [o for o in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if o[0] != "equal"]


def by_automaton(old, new, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(line_match, "MANY_PAIRS", -1)
        return line_match.changed_blocks(old, new)


def test_blocks_of_random_pairs(monkeypatch):
    rng = random.Random(7)
    for _ in range(10_000):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        old = rng.choices(letters, k=rng.randint(0, 14))
        new = rng.choices(letters, k=rng.randint(0, 14)) if rng.random() < 0.5 else [x for x in old if rng.random() > 0.2] + rng.choices(letters, k=rng.randint(0, 3))
        want = plainly(old, new)
        assert by_automaton(old, new, monkeypatch) == want and line_match.changed_blocks(old, new) == want
    for n in (200, 400):
        old = [rng.choice(["", "}", "    return", str(rng.randrange(40))]) for _ in range(n)]
        new = [x for x in old if rng.random() > 0.1]
        new[n // 3 : n // 3] = ["", "}", "new"] * 5
        assert by_automaton(old, new, monkeypatch) == plainly(old, new)


def test_repeated_lines_take_linear_time():
    began = time.perf_counter()
    assert line_match.changed_blocks(["x"] * 100_000, ["x"] * 99_990) == [("delete", 99_990, 100_000, 99_990, 99_990)]
    assert line_match.changed_blocks(["", "}"] * 30_000, ["", "}"] * 30_000 + ["end"]) == [("insert", 60_000, 60_000, 60_000, 60_001)]
    assert time.perf_counter() - began < 20
