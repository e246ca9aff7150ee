"""SentencePiece BPE encoding by backtracking, and decoding.

The encoder finds the unique merge result without running merges over the
text.  An Aho-Corasick automaton gives the longest vocabulary entry at each
position.  A token may follow another only if re-merging the two tokens' text,
followed along the seam between them, gives exactly these two.  Where no entry fits, the encoder steps back one token
and marks the position as failed in a bitfield, so no position fails twice.

A text is cut at word starts first: no entry of the supported models has the
word mark after another character, so no merge crosses a cut, and the pieces
repeat enough to be worth remembering (in a bounded cache per worker).
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import held, text_or_empty, workers_import_this

MARK = "▁"
#: Entries of a generation of a worker's memory; it has two, and drops the older when the younger is full.
#: 50,000 take some 120 MB a worker, 150,000 some 180 MB for a quarter less time, 400,000 up to 350 MB.
REMEMBER = 50_000
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Backtracker:
    """Encoder and decoder for one BPE model file.

    Supports models with the identity normaliser, a dummy prefix and byte
    fallback; raises ``ValueError`` for others.
    """

    def __init__(self, model_file: str, remember: int = REMEMBER):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = "ﬁ  Ａ "
        if model.normalize(probe) != (MARK + probe).replace(" ", MARK):
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        self.ids: dict[str, int] = {}
        self.pieces: list[str] = []
        self.bytes: dict[int, int] = {}
        self.byte_ids = [0] * 256
        self.scores: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.pieces.append(piece)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[i] = value
                self.byte_ids[value] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in self.ids) or not set(string.ascii_letters) <= self.ids.keys():
            raise ValueError("only models with byte fallback, all ASCII letters and word marks at the start are supported")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p in self.ids}
        self.compatible = functools.lru_cache(1 << 18)(self._compatible)
        self.reachable = functools.lru_cache(1 << 16)(lambda a: self.merged(a) == [a])
        self.halves = functools.lru_cache(1 << 16)(self._halves)
        self.joints = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.stems, self.kept = _Kept(self._stem, remember), _Kept(self._word, remember)

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """Plain merging, best score first and leftmost among equals; for short texts."""
        parts = list(text)
        while True:
            if len(parts) <= down_to:
                return parts
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _halves(self, token: str) -> tuple[str, str] | None:
        """What the last merge of a token joined; None for a single character."""
        parts = self.merged(token, down_to=2)
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _compatible(self, a: str, b: str) -> bool:
        """Whether merging the text of two reachable tokens gives these two again.

        Undoes the later of the two tokens' last merges at the seam, again and
        again, and looks whether the parts that then met would have merged
        first.  Runs of word marks have equal scores, so these are merged again.
        """
        if a[-1] == MARK or not (self.reachable(a) and self.reachable(b)):
            return self.merged(a + b) == [a, b]
        score, low, strict = self.scores.get, float("-inf"), False
        # a pair at the seam wins if its score is above ``low``, or equal and ``strict`` is false
        while True:
            joined = score(a + b)
            if joined is not None and (joined > low or joined == low and not strict):
                return False
            left, right = self.halves(a), self.halves(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and self.scores[a] < self.scores[b]:
                low, strict, a = self.scores[a], True, left[1]
            else:
                low, strict, b = self.scores[b], False, right[0]

    def encode_known(self, text: str) -> list[str]:
        """Tokens of a text all of whose characters are entries."""
        n = len(text)
        longest = [0] * (n + 1)
        for end, size in self.automaton.iter(text):
            start = end + 1 - size
            if size > longest[start]:
                longest[start] = size
        failed = bytearray((n >> 3) + 1)  # a bit per position
        tokens: list[str] = []
        at, token, last = 0, text[: longest[0]], None
        fits, shorter = self.compatible, self.shorter
        while token:
            end = at + len(token)
            if not failed[end >> 3] >> (end & 7) & 1 and (fits(last, token) if last else self.reachable(token)):
                tokens.append(token)
                last, at, token = token, end, text[end : end + longest[end]]
            elif shorter[token]:
                token = shorter[token]
            else:
                if last is None:
                    raise ValueError(f"no encoding for {text!r}")
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(last)
                token = tokens.pop()
                last = tokens[-1] if tokens else None
        return tokens

    def encode_piece(self, text: str) -> list[int]:
        """Ids of a text in which spaces are already word marks.

        Cut where no entry has the two characters side by side: no merge
        crosses such a place.  A character that is no entry becomes its bytes.
        """
        if text[1:].isascii() and text[1:].isalpha():  # entries all; cutting such a word would save nothing
            return list(self.stems[text])
        joints, stems, out, start = self.joints, self.stems, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joints:
                out += stems[text[start:i]]
                start = i
        return out + list(stems[text[start:]])

    def _stem(self, text: str) -> tuple[int, ...]:
        if len(text) == 1 and text not in self.ids:
            return tuple(map(self.byte_ids.__getitem__, text.encode()))
        return tuple(map(self.ids.__getitem__, self.encode_known(text)))

    def decode_piece(self, ids: list[int]) -> str:
        if self.bytes.keys().isdisjoint(ids):
            return "".join(map(self.pieces.__getitem__, ids)).replace(MARK, " ")
        out, pending = [], bytearray()
        for i in ids:
            if i in self.bytes:
                pending.append(self.bytes[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending = bytearray()
            out.append(self.pieces[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def words(self, text: str) -> list[str]:
        """Cuts of a text, each without its leading mark."""
        if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def _word(self, word: str) -> str | tuple[str, str]:
        """Decimal ids joined by commas; with the decoded text, where that is not the word after a space."""
        ids = self.encode_piece(MARK + word)
        joined, decoded = ",".join(map(str, ids)), self.decode_piece(ids)
        return joined if decoded == " " + word else (joined, decoded)

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.round_trip(text)[0].split(","))) if text else []

    def round_trip(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by commas, and the text decoded from these ids."""
        if not text:
            return "", ""
        words = self.words(text)
        found = list(map(self.kept.__getitem__, words))
        with contextlib.suppress(TypeError):  # a pair among them
            return ",".join(found), " ".join(words)
        pairs = [(f, " " + w) if isinstance(f, str) else f for f, w in zip(found, words, strict=True)]
        return ",".join([p[0] for p in pairs]), "".join([p[1] for p in pairs])[1:]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_piece(ids)
        return text[1:] if text[:1] == " " else text


class _Kept(dict):
    """Results of ``make`` for short keys that came up twice: what was used lately stays."""

    MARKS = 1 << 19

    def __init__(self, make, remember: int):
        super().__init__()
        self.make, self.remember, self.older, self.met, self.marked = make, remember, {}, bytearray(self.MARKS), 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            mark = hash(key) & (self.MARKS - 1)
            if not self.met[mark]:
                self.met[mark] = 1
                self.marked += 1
                if 2 * self.marked > self.MARKS:
                    self.met, self.marked = bytearray(self.MARKS), 0
                return value
        if len(key) <= 64:
            if len(self) >= self.remember:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def _model(model_file: str, remember: int) -> Backtracker:
    return held(("sentencepiece", model_file, remember), lambda: Backtracker(model_file, remember))


def encode(df: DataFrame, model_file: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids (array of int) of each whole text.

    A null text counts as empty and gives an empty array; texts of any length
    are encoded whole; an existing column of that name is replaced.
    """
    spark = df.sparkSession
    workers_import_this(spark)
    encoded = F.pandas_udf(lambda s: s.map(_model(model_file, REMEMBER).encode), "array<int>")
    return df.withColumn(out, encoded(text_or_empty(text)))


def encode_digests(spark: SparkSession, docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """Per row: the key, the number of ids, and digests of ids and decoded text.

    Rows are independent, so repeated rows repeat and an empty table gives an
    empty one.  A null text counts as empty: no ids, digests of nothing.
    """
    workers_import_this(spark)
    slim = docs.select(F.col(key), text_or_empty(text).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_file, remember)
        for batch in batches:
            n, ids, decoded = [], [], []
            for t in batch.column(1):
                t = t.as_py()
                joined, back = model.round_trip(t)
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return slim.mapInArrow(digests, f"{key} {slim.schema[key].dataType.simpleString()}, {SCHEMA}")
