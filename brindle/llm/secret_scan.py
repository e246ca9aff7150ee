"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary spends few tokens on text like that it was made from and
many on random strings.  A run of key characters with few characters per token
is reported.  Digests, UUIDs and numbers are known forms: they are cut out of a
run first, and each stretch between them is judged as a run of its own, whole and
by what is random within it: a part between ``/ = - _ +``, or a window.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import text_or_empty, workers_import_this

# The base patterns and the words that one of them starts with.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
# Lengths in hexadecimal digits of common digests.
DIGEST_LENGTHS = frozenset({32, 40, 48, 56, 64, 96, 128})

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
#: Known forms within a run, with a joint or an end of the run on both sides: UUIDs, digests, and numbers
#: of two parts or more (dates, times, versions) or of ``LEAST_DIGITS``.
KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:" + UUID.pattern.replace("[0-9a-f]", "[0-9A-Fa-f]") + "|" + "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in sorted(DIGEST_LENGTHS))
    + r"|(?P<number>[vV]?[0-9]+(?:[-_/+=T]+[0-9]+)*Z?))(?![A-Za-z0-9])"
)
LEAST_DIGITS = 4
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Words of letters, each with digits at its end at most: names, paths, slugs.
WORDS = re.compile(r"[/_=+-]*(?:[A-Za-z][a-z]{2,}[0-9]{0,4}(?:[/_=+-]+|(?=[A-Z])|$))+|[A-Z]+(?:_[A-Z]+)*|[a-z]+")
PART = re.compile(r"[A-Za-z0-9]+")

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


@dataclass(frozen=True)
class TokenEfficiency:
    """Parameters: the rank file, its split pattern, and the ratio below which a run is random."""

    rank_file: str
    pattern: str
    chars_per_token: float = 2.2
    #: Runs beyond this many characters are encoded in pieces of this size.
    window: int = 4096
    #: Letters and digits in the windows of a run that are judged, at least.
    windows: tuple[int, ...] = (20, 32, 64)
    #: A window with a larger share of ``/ = - _ +`` is a list of short words.
    joints: float = 0.2


@functools.lru_cache(2)
def _encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end (code points, end exclusive) and kind of what the fixed patterns find."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def is_known_form(run: str) -> bool:
    """Digests by their length, UUIDs and decimal numbers."""
    return bool(run.isdigit() or UUID.fullmatch(run) or HEX_ONLY.fullmatch(run) and len(run) in DIGEST_LENGTHS)


def random_spans(text: str, test: TokenEfficiency, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs that the token-efficiency test exposes, but for those inside ``taken`` (in order)."""
    starts, reach = [s[0] for s in taken], list(itertools.accumulate((s[1] for s in taken), max))

    def inside(a: int, b: int) -> bool:
        at = bisect.bisect_right(starts, a)
        return at > 0 and reach[at - 1] >= b

    found = []
    for m in RUN.finditer(text):
        if is_known_form(m[0]) or inside(*m.span()):
            continue
        for at, stretch in stretches(m[0], min(test.windows)):
            spans = [(m.start() + at + i, m.start() + at + j) for i, j in random_parts(stretch, test)]
            found += [(a, b, "random") for a, b in spans if not inside(a, b)]
    return found


def stretches(run: str, least: int) -> Iterator[tuple[int, str]]:
    """What is left of a run without its known forms, from ``least`` characters on, and where it begins; joints beside a cut go with it."""
    at = 0
    for m in KNOWN.finditer(run):
        if m["number"] and len(m["number"].strip("vVZ")) < LEAST_DIGITS and m["number"].strip("vVZ").isdigit():
            continue
        yield from _trimmed(run, at, m.start(), at > 0, True, least)
        at = m.end()
    yield from _trimmed(run, at, len(run), at > 0, False, least)


def _trimmed(run: str, a: int, b: int, left: bool, right: bool, least: int) -> Iterator[tuple[int, str]]:
    while left and a < b and not run[a].isalnum():
        a += 1
    while right and a < b and not run[b - 1].isalnum():
        b -= 1
    if b - a >= least:
        yield a, run[a:b]


def random_parts(run: str, test: TokenEfficiency) -> list[tuple[int, int]]:
    """A stretch, if it is random, else what is random in it: parts and windows, joined where they overlap.

    Letters and digits between two joints are a part.  Tokens of joints don't
    count in parts and windows.  A stretch of words, or without a letter or a
    digit, is judged by its parts and windows only.
    """
    encode = _encoding(test.rank_file, test.pattern).encode_ordinary
    if re.search("[0-9]", run) and re.search("[A-Za-z]", run) and not WORDS.fullmatch(run):
        pieces = [run[i : i + test.window] for i in range(0, len(run), test.window)]
        if len(run) < test.chars_per_token * sum(len(encode(p)) for p in pieces):
            return [(0, len(run))]
    spans, stretch = [], []
    for part in PART.finditer(run):
        a, b = part.span()
        tokens = _tokens(part[0], a, test)
        if b - a >= min(test.windows) and b - a < test.chars_per_token * len(tokens):
            spans.append((a, b))
        stretch += tokens
    spans += _windows(stretch, test)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _tokens(part: str, at: int, test: TokenEfficiency) -> list[tuple[int, int]]:
    """Start and end of each token of a part that begins at ``at``."""
    encoding, out = _encoding(test.rank_file, test.pattern), []
    for i in range(0, len(part), test.window):
        for token in encoding.encode_ordinary(part[i : i + test.window]):
            out.append((at, at + len(encoding.decode_single_token_bytes(token))))
            at = out[-1][1]
    return out


def _windows(tokens: list[tuple[int, int]], test: TokenEfficiency) -> list[tuple[int, int]]:
    """From each token on, the shortest span with as many characters in tokens as a window has, if it is random."""
    found = []
    for least in test.windows:
        j = chars = 0
        for i, (a, b) in enumerate(tokens):
            while j < len(tokens) and chars < least:
                chars += tokens[j][1] - tokens[j][0]
                j += 1
            if chars < least:
                break
            span = tokens[j - 1][1] - a
            if chars < test.chars_per_token * (j - i) and span - chars <= test.joints * span:
                found.append((a, tokens[j - 1][1]))
            chars -= b - a
    return found


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, test: TokenEfficiency, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts by kind, a digest of the base spans, and all spans.

    Whole texts are scanned, however long; a null text counts as empty and has
    no spans.  Rows are independent: repeated rows repeat, an empty table gives
    an empty one, other columns are not read.
    """
    workers_import_this(docs.sparkSession)
    slim = docs.select(F.col(key), text_or_empty(text).alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base = base_spans(t := t.as_py())
                more = random_spans(t, test, base)
                n = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(more)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *(c.split()[0] for c in SCHEMA.split(", "))])

    return slim.mapInArrow(scanned, f"{key} {slim.schema[key].dataType.simpleString()}, {SCHEMA}")
