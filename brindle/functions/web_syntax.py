"""Syntax errors of TypeScript and JavaScript that show between neighbouring tokens.

Not a grammar: only what no place of a program allows is an error, so a valid
file is never refused, and an error that needs more than two tokens to see is
not found.
"""

from __future__ import annotations

from collections.abc import Sequence

# Operators with an operand on both sides, those that may also stand before one,
# words that a bracket follows, words that begin a declaration, and words that may follow a literal.
BETWEEN = frozenset("= == === != !== <= >= && || ?? ** % += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BEFORE = frozenset("+ - * /".split())
BRACKETED = frozenset("if while switch for".split())
DECLARING = frozenset("const let var".split())
STATEMENTS = frozenset("const let var function return if for while switch class throw".split())
AFTER_LITERAL = frozenset("in instanceof as satisfies of from with assert is extends implements".split())
ENDS = frozenset((")", "]", "}", ",", ";", ""))
BEGINS = frozenset(("(", "[", "${", ",", ";", "=>", "?.", ""))


def error_in(tokens: Sequence, line_of) -> str | None:
    """The first error, with its line, or None; ``tokens`` have kind, text, start and fresh."""
    for i in range(len(tokens) + 1):
        before, after = (tokens[i - 1] if i else None), (tokens[i] if i < len(tokens) else None)
        if wrong := _between(before, after, tokens[i - 2] if i > 1 else None):
            return f"{wrong} in line {line_of((after or before).start)}"
    return None


def _between(a, b, before_a) -> str | None:
    """What is wrong with a token after another; either may be missing, at the ends of a file."""
    left, right = a.kind if a else "", b.kind if b else ""
    if left in BETWEEN and (right in ENDS or right in BETWEEN or right == "=>"):
        return f"nothing after {left}"
    if right in BETWEEN and left in BEGINS:
        return f"nothing before {right}"
    if left in BEFORE and right in ENDS and not (left in "+-" and right == "]"):
        return f"nothing after {left}"
    if a is None or a.kind == "name" and before_a is not None and before_a.kind in (".", "?.", "#", "as"):
        return None
    if left == "name" and a.text in BRACKETED and (right in ("number", "string", "regex", "") or right == "name" and b.text not in ("as", "await", "from", "in", "of")):
        return f"no bracket after {a.text}"
    if left == "name" and a.text in DECLARING and right == "name" and not b.fresh and b.text in STATEMENTS and before_a_is_no_word(before_a):
        return f"{a.text} before {b.text}"
    if _literal(a) and b is not None and not b.fresh and (_literal(b) or left == "number" and right == "name" and b.text not in AFTER_LITERAL):
        return f"{a.text[:20]} before {b.text[:20]}"
    return None


def before_a_is_no_word(token) -> bool:
    """Whether what comes before a declaration's word isn't a word that makes a name of it."""
    return token is None or token.kind != "name" or token.text not in ("as", "get", "set", "static", "async", "import", "from")


def _literal(token) -> bool:
    """A number or a quoted string; parts of templates are none."""
    return token is not None and (token.kind == "number" or token.kind == "string" and token.text[:1] in "\"'")
