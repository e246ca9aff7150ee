"""What requests may ask for: one table of bounds, for every verb."""

from __future__ import annotations

import math

# The bounds of numbers, the choices, and the sizes of texts and lists.
RANGES = {
    "limit": (1, 50), "depth": (0, 5), "max_depth": (0, 5), "max_tokens": (128, 32000), "max_steps": (2, 10), "max_seconds": (0.1, 120),
    "context_budget": (512, 32000), "output_budget": (128, 8192), "evidence_room": (128, 32000), "repetitions": (1, 10),
}
CHOICES = {"retrieval": ("hybrid", "legacy"), "detail": ("compact", "full")}
MOST_CHARS, MOST_SYMBOLS = 2000, 20
SELECTORS = ("task", "symbols", "ref")


def check(**asked) -> None:
    """``ValueError`` for the first value that is out of its bounds; names without bounds are texts."""
    for name, value in asked.items():
        if name in RANGES:
            low, high = RANGES[name]
            whole = isinstance(low, float) or type(value) is int
            if not whole or not math.isfinite(value) or not low <= value <= high:
                raise ValueError(f"{name} must be {low} to {high}")
        elif name in CHOICES:
            if value not in CHOICES[name]:
                raise ValueError(f"{name} must be {' or '.join(CHOICES[name])}")
        elif name == "symbols":
            if not 1 <= len(value) <= MOST_SYMBOLS:
                raise ValueError(f"give 1 to {MOST_SYMBOLS} symbols")
            for text in value:
                check(symbol=text)
        elif not value.strip() or len(value) > MOST_CHARS:
            raise ValueError(f"{name} must have 1 to {MOST_CHARS} characters")


def selector(**asked) -> str:
    """Which one of the selectors is given; ``ValueError`` unless it is exactly one, within its bounds."""
    given = {k: v for k, v in asked.items() if v is not None}
    if len(given) != 1:
        raise ValueError(f"give exactly one of {', '.join(asked)}")
    check(**given)
    return next(iter(given))
