"""Changed blocks of two lists: the longest common block first, then what is left and right of it.

Of the longest common blocks the one that starts earliest in the old list is
taken, of these the one that starts earliest in the new.  Where lines repeat
much, pairs of equal lines are very many; a block is then found by a suffix
automaton of the new list's part, in time linear in both parts.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Hashable, Sequence

#: Pairs of equal lines, for each line, from which the automaton is quicker.
MANY_PAIRS = 64


def changed_blocks(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[tuple[str, int, int, int, int]]:
    """(replace, delete or insert, from and to in old, from and to in new), in order."""
    counts = Counter(new)
    if sum(counts[x] for x in old) <= MANY_PAIRS * (len(old) + len(new)):
        matched = difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks()
    else:
        matched = [*sorted(common_blocks(old, new)), (len(old), len(new), 0)]
    out, i, j = [], 0, 0
    for a, b, size in matched:
        kind = "replace" if i < a and j < b else "delete" if i < a else "insert"
        if i < a or j < b:
            out.append((kind, i, a, j, b))
        i, j = a + size, b + size
    return out


def common_blocks(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """(start in old, start in new, length) of all common blocks, in no order."""
    out, open_ = [], [(0, len(old), 0, len(new))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        a, b, size = longest(old, a0, a1, new, b0, b1)
        if size:
            out.append((a, b, size))
            open_ += [(a0, a, b0, b), (a + size, a1, b + size, b1)]
    return out


def longest(old: Sequence[Hashable], a0: int, a1: int, new: Sequence[Hashable], b0: int, b1: int) -> tuple[int, int, int]:
    """The longest common block of two parts; length 0 if there is none.

    States of the automaton are classes of the part of ``new``: ``size`` is the
    longest run in a class, ``first`` where its first occurrence ends.
    """
    follow: list[dict[Hashable, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for at in range(b0, b1):
        x, state = new[at], len(size)
        follow.append({})
        size.append(size[last] + 1)
        first.append(at)
        link.append(0)
        p = last
        while p >= 0 and x not in follow[p]:
            follow[p][x] = state
            p = link[p]
        if p >= 0:
            q = follow[p][x]
            if size[p] + 1 == size[q]:
                link[state] = q
            else:
                copy = len(size)
                follow.append(dict(follow[q]))
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and follow[p].get(x) == q:
                    follow[p][x] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    state = n = 0
    best = (a0, b0, 0)
    for at in range(a0, a1):
        x = old[at]
        while state and x not in follow[state]:
            state = link[state]
            n = size[state]
        if x in follow[state]:
            state, n = follow[state][x], n + 1
        else:
            n = 0
        if n > best[2]:  # the first of a length in ``old`` is met first; where it is in ``new`` first, its class knows
            best = (at - n + 1, first[state] - n + 1, n)
    return best
