"""Benchmark decontamination: Wu-Manber search for all windows of all benchmark items at once.

The symbols are words (lower-cased A-Z; maximal runs of ASCII letters, ASCII digits and non-ASCII characters), the patterns
are the windows: WINDOW consecutive words of an item, or the whole of a shorter item. For patterns of m words a table gives
each block of two words the distance that the search may advance when it stands on that block: m - 1 if the block is in no
pattern, less by the block's last position otherwise. Where the distance is 0 the block is a pattern's suffix; the bucket
under its hash holds the patterns that end so, first words first compared, and a direct comparison confirms. A text without
benchmark words is thus read at every twelfth word. Items shorter than a window have their own tables by length.

The windows are the query set: they go to every task in blocks of bounded size. Long items are cut into pieces that share a
window less a word, so a block can always be bounded. Of several blocks each is one more pass over the texts, whose result is
written before the next block is read, so neither a task nor the driver holds more than one block; a benchmark of any size takes
time but no more memory. No shuffle of texts.

Defined cases: very long texts are searched as a whole; null texts and texts without words have no hit and are clean; null or empty items are no patterns; an item id
that occurs on several rows counts once, a null id as the empty string; repeated documents are rows like any other; other
columns pass through; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

WINDOW = 13
#: A document is contaminated if 1 / SHARE of its words or more are hit.
SHARE = 20
#: Bytes of item texts in one block of patterns, on average; words of a piece of an item beyond a window, at most.
BLOCK_BYTES, PIECE_WORDS = 8 << 20, 2_000

_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class WuManber:
    """Patterns of one length m over word lists."""

    def __init__(self, m: int, patterns: Iterable[tuple[tuple[bytes, ...], str]]) -> None:
        self.m, self.size = m, min(2, m)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(set))
        for pattern, item in patterns:
            for k in range(self.size - 1, m):
                block = self._block(pattern, k)
                self.shift[block] = min(self.shift.get(block, m), m - 1 - k)
            self.buckets[self._block(pattern, m - 1)][pattern].add(item)
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def _block(self, w: list[bytes] | tuple[bytes, ...], k: int):
        return (w[k - 1], w[k]) if self.size == 2 else w[k]

    def search(self, w: list[bytes]) -> list[tuple[int, set[str]]]:
        """(start, items) of every occurrence."""
        m, out, n = self.m, [], len(w)
        far, shift, two = m - self.size + 1, self.shift, self.size == 2
        k = m - 1
        while k < n:
            d = shift.get((w[k - 1], w[k]) if two else w[k], far)
            if d:
                k += d
                continue
            bucket = self.buckets[self._block(w, k)]
            start = k - m + 1
            if (items := bucket.get(tuple(w[start : k + 1]))) is not None:
                out.append((start, items))
            k += 1
        return out


def tables(items: Iterable[tuple[str, bytes]]) -> list[WuManber]:
    """A table for each pattern length of the items (id, text)."""
    by_length: dict[int, list[tuple[tuple[bytes, ...], str]]] = defaultdict(list)
    for item, text in items:
        w = words(text)
        if w:
            m = min(WINDOW, len(w))
            by_length[m] += [(tuple(w[k : k + m]), item) for k in range(len(w) - m + 1)]
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def _pieces(text: Column) -> Column:
    """The words of each text between blanks, in pieces that together have all of its windows."""

    @F.arrow_udf("array<binary>")
    def pieces(batch: pa.Array) -> pa.Array:
        out = []
        for item in batch.to_pylist():
            w = words(item)
            starts = range(0, max(1, len(w) - WINDOW + 1), PIECE_WORDS) if w else ()
            out.append([b" ".join(w[k : k + PIECE_WORDS + WINDOW - 1]) for k in starts])
        return pa.array(out, pa.list_(pa.binary()))

    return pieces.asNondeterministic()(text)


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(item, text, block): the distinct pieces of the items, staged, dealt to blocks of some ``most`` bytes; and the number of
    blocks."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.explode(_pieces(F.col("text").cast("binary"))).alias("text"))
    rows = staged(rows.distinct(), "benchmark")
    n = max(1, -(-rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] // most))
    return rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def block_items(dealt: DataFrame, k: int) -> list[tuple[str, bytes]]:
    return [(r["item"], bytes(r["text"])) for r in dealt.where(F.col("block") == k).select("item", "text").toLocalIterator()]


HITS = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"


def _search(items: list[tuple[str, bytes]]):
    """Of a text, and the spans and items that other blocks had found: the number of words, all spans, merged, and all items, sorted."""
    built: list[list[WuManber]] = []

    @F.arrow_udf(HITS)
    def search(batch: pa.Array, before: pa.Array, known: pa.Array) -> pa.Array:
        if not built:
            built.append(tables(items))
        n, spans, found = [], [], []
        for text, old, of in zip(batch, before, known, strict=True):
            w = words(text.as_py())
            old, of = old.as_py(), set(of.as_py())
            at = set(zip(old[::2], old[1::2], strict=True))
            for t in built[0]:
                for start, own in t.search(w):
                    at.add((start, start + t.m))
                    of |= own
            n.append(len(w))
            spans.append([x for s in _merged(at) for x in s])
            found.append(sorted(of))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], names=["n_words", "spans", "items"])

    return search.asNondeterministic()


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, column: str = "hits", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct of n_words, n_hit, n_items, items_sha256, items (sorted), spans (word ranges), contaminated."""
    (tmp,) = fresh(docs, "block_hits")
    dealt, n = blocks(benchmark, block_bytes)
    spans, items = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    out = docs
    for k in range(n):
        out = out.withColumn(tmp, _search(block_items(dealt, k))(F.col(text).cast("binary"), spans, items))
        if n > 1:
            out = staged(out, "searched")
        spans, items = F.col(tmp)["spans"], F.col(tmp)["items"]
    n_words = F.col(tmp)["n_words"]
    # merged spans: the sum of the ends less the sum of the starts
    n_hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    struct = F.struct(
        n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        items.alias("items"), spans.alias("spans"), ((n_hit > 0) & (SHARE * n_hit >= n_words)).alias("contaminated"),
    )
    return out.withColumn(column, struct).drop(tmp)


def keep(docs: DataFrame, benchmark: DataFrame, any_hit: bool = True) -> DataFrame:
    """The rows without a benchmark window, with the columns of ``docs``. With any_hit off, rows with fewer hit words than the
    share that makes them ``contaminated`` stay too: a long document may then hold a whole item."""
    (hits,) = fresh(docs, "hits")
    h = F.col(hits)
    return contamination(docs, benchmark, hits).where(h["n_hit"] == 0 if any_hit else ~h["contaminated"]).drop(hits)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", *[F.col("hits")[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_W} AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least({WINDOW}, len(w)) AS m, list_slice(w, i, i + least({WINDOW}, len(w)) - 1) AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_W} AS w FROM documents
), g AS (
  SELECT rid, i, l.m AS m, list_slice(w, i, i + l.m - 1) AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN (SELECT DISTINCT m FROM p) AS l WHERE i + l.m - 1 <= len(w)
), h AS (
  SELECT rid, i, g.m AS m, item FROM g JOIN p ON g.m = p.m AND g.s = p.s
), c AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS q FROM h) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
