"""Measurements of whole texts, vectorised over the bytes of Arrow batches.

Words are maximal runs of characters other than the ASCII blanks 09-0D and 20. All of them are single bytes in UTF-8, so
splitting the bytes equals splitting the characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = b" \t\n\x0b\x0c\r"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64), dtype=np.uint64)]) for x in (base, inverse))
    return up, down


class SpanHash:
    """64-bit hashes of byte spans: differences of a running sum of per-byte random values times powers of an odd base."""

    def __init__(self) -> None:
        self.table = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(1 << 16)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = _powers(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (sums[end] - sums[start]) * self.down[start]
            x ^= x >> _S32
            x *= _MIX
            x ^= x >> _S32
            return x + (end - start).astype(np.uint64) * _GOLD


_HASH: list[SpanHash] = []


def span_hash() -> SpanHash:
    """One per Python process; the same values in each."""
    if not _HASH:
        _HASH.append(SpanHash())
    return _HASH[0]


def words_joined(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single blanks, and their starts and ends in that string."""
    joined = b" ".join(text.split())
    if not joined:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return joined, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])


def shingles(text: bytes, k: int) -> np.ndarray:
    """Hash of each k-word window in order; with fewer words, of the whole sequence; without any, none."""
    joined, start, end = words_joined(text)
    if not len(start):
        return np.zeros(0, np.uint64)
    h = span_hash()
    k = min(k, len(start))
    return h.spans(h.sums(np.frombuffer(joined, np.uint8)), start[: len(start) - k + 1], end[k - 1 :])


def repeated_words(windows: np.ndarray, n_words: int, k: int) -> int:
    """Words that lie in windows of k words that occur twice or more."""
    if n_words <= k:
        return 0
    _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[back] > 1)
    if not len(hit):
        return 0
    cover = np.zeros(n_words + 1, np.int32)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


#: Measurement and its bytes. Fixed character classes.
CLASSES = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "n_lower": b"abcdefghijklmnopqrstuvwxyz",
    "n_digits": b"0123456789",
    "n_bang": b"!?",
    "n_stops": b".,;:",
}
FIELDS = ("n_bytes", "n_chars", "n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_repeat_next", "n_long_words", *CLASSES)
SCHEMA = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">"


def measure(text: bytes | None) -> tuple[int, ...]:
    """The FIELDS of one text; null counts as empty.

    n_repeat_next: words equal to the word before; n_long_words: of more than 30 bytes; n_dup_lines: lines with a word,
    equal to an earlier line; n_lines: lines with a word.
    """
    text = text or b""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    joined, start, end = words_joined(text)
    n = len(start)
    chars = len(text) - int(count[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    repeat = distinct = again = 0
    if n:
        h = span_hash()
        sums = h.sums(np.frombuffer(joined, np.uint8))
        each = h.spans(sums, start, end)
        distinct, again = len(np.unique(each)), int((each[1:] == each[:-1]).sum())
        if n > 3:
            repeat = repeated_words(h.spans(sums, start[: n - 2], end[2:]), n, 3)
    of = [int(count[list(x)].sum()) for x in CLASSES.values()]
    return (len(text), chars, n, chars - int(count[list(BLANK)].sum()), len(lines), len(lines) - len(set(lines)), repeat, distinct, again, int((end - start > 30).sum()), *of)


def measure_column(text: Column) -> Column:
    """Struct of FIELDS of a text column, in one pass of an Arrow function over its bytes."""

    @F.arrow_udf(SCHEMA)
    def measured(batch: pa.Array) -> pa.Array:
        rows = [measure(x) for x in batch.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(FIELDS))

    return measured.asNondeterministic()(text.cast("binary"))
