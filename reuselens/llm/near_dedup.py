"""Near duplicates: MinHash bands for candidates, sequential Bayesian verification, exact confirmation, components.

1. Each text becomes its set of k-word shingles (64-bit hashes) and a digest of that set. Texts with equal sets form a class, a
   node; from here on only one text of each class is looked at.
2. A node has one key per band of its MinHash signature. A bucket is the nodes with one key; its least member is its leader.
   Two members of a bucket share its leader, so every candidate pair meets again among the distinct (leader, member) rows,
   whose number is linear in the input.
3. A leader's members are split into blocks of bounded size, each with a copy of the leader: a unit of work that any task can
   take. There signatures are compared batch after batch, a pair is dropped once the posterior probability that its similarity
   reaches the threshold falls below the chosen miss probability, and survivors are verified on their full sets, most
   similar first. A pair that links already connect within the unit needs no further check. A unit returns its spanning
   links, at most one per member, and the members that it could not connect with the leader.
4. Members that were connected are one component with the leader, in whatever blocks they are. Only the others, if there are
   any in a leader of several blocks, meet the members of the other blocks, again in units of two bounded sides.
5. Components over the links, and back to all documents by class digest.

Texts are shuffled only if their id's bit is set in a bitmap of the ids that are needed (``common.maybe_in``).

A pair at the threshold itself meets in no band with probability (1 - t^rows)^bands, 4e-6 for 32 bands of 7 at 0.85 and 5e-6
for 40 of 6 at 0.80, and is pruned with probability below MISS. Nothing is capped: hot buckets become more units.

Defined cases: null or wordless texts have an empty set, are linked with nothing and kept; rows without id are linked with
nothing, component_id null, kept; fewer than k words are one shingle; very long texts are whole sets, and a unit has fewer of
them; rows that repeat an id are one node of the graph, whatever their texts, so they have one component; other columns do not
matter; ties go to the least id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed_join, maybe_in, staged
from .components import components
from .textstats import shingles

#: Bands and hashes of a band: for the default threshold of 0.80, and for 0.85.
BANDS, ROWS = 40, 6
BANDS_85, ROWS_85 = 32, 7
#: Hashes compared at a time, and the probability with which a pair at the threshold may be pruned in all batches together.
BATCH, MISS = 32, 1e-6
#: A block's members and shingles, at most on average.
BLOCK_DOCS, BLOCK_SHINGLES = 192, 2_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    return np.unique(shingles((text or b"").translate(_LOWER), k))


_MINHASH: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def signature(x: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values (uint32) of a non-empty set of 64-bit hashes, in cache-sized pieces."""
    if size not in _MINHASH:
        g = np.random.Generator(np.random.PCG64(977))
        _MINHASH[size] = (g.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1), g.integers(0, 2**32, size, dtype=np.uint32))
    mul, add = _MINHASH[size]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    low, high = (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 256):
            v = low[k : k + 256, None] * mul
            v += add
            v ^= high[k : k + 256, None]
            v *= np.uint32(0x9E3779B1)
            np.minimum(out, v.min(0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, from the band's values and its number."""
    v = sig.reshape(bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(rows):
            key = (key ^ v[:, j]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _sets(text: Column, k: int, bands: int, rows: int) -> Column:
    """Struct of the set's size, digest and band keys; the latter two are null for an empty set."""

    @F.arrow_udf("struct<n:bigint,digest:binary,keys:array<bigint>>")
    def sets(batch: pa.Array) -> pa.Array:
        n, digest, keys = [], [], []
        for t in batch.to_pylist():
            x = shingle_set(t, k)
            n.append(len(x))
            digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
            keys.append(band_keys(signature(x, bands * rows), bands, rows) if len(x) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["n", "digest", "keys"])

    return sets.asNondeterministic()(text.cast("binary"))


@cache
def least_matches(threshold: float, size: int, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """For each number of compared hashes, the least matches with which a pair survives.

    With a uniform prior the posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1); a pair survives
    while it gives the range from ``threshold`` up a probability of ``miss`` / batches or more. For whole numbers that tail
    is the binomial sum P(Bin(n + 1, threshold) <= m).
    """
    out, share = [], miss / max(1, math.ceil(size / batch))
    for n in range(batch, size + batch, batch):
        n = min(n, size)
        total, m = 0.0, -1
        while total < share and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def unit_links(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, size: int, meets: np.ndarray | None = None, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of one unit. meets: pairs that count (all, if not given). joined: members that are connected already."""
    n = np.array([len(x) for x in sets])
    sig = np.stack([signature(x, size) for x in sets]).astype(np.uint16)  # 16 bits agree by chance once in 65,536
    least = least_matches(num / den, size)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        if meets is not None:
            j = j[meets[i, j]]
        # a ratio of sizes below the threshold excludes a link
        j = j[den * np.minimum(n[j], n[i]) >= num * np.maximum(n[j], n[i])]
        m = np.zeros(len(j), np.int64)
        for k, need in zip(range(0, size, BATCH), least, strict=True):
            if not len(j):
                break
            m = m + (sig[j, k : k + BATCH] == sig[i, k : k + BATCH]).sum(1)
            live = m >= need
            j, m = j[live], m[live]
        if len(j):
            found.append((np.full(len(j), i), j, m))
    if not found:
        return []
    a, b, m = (np.concatenate(x) for x in zip(*found, strict=True))
    forest, links = _Forest(), []
    if joined is not None and joined.any():
        first, *rest = np.flatnonzero(joined)
        for k in rest:
            forest.link(int(first), int(k))
    for k in np.argsort(-m, kind="stable"):
        i, j = int(a[k]), int(b[k])
        if forest.find(i) == forest.find(j):
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
            forest.link(i, j)
            links.append((int(ids[i]), int(ids[j])))
    return links


def star_links(leader: int, ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, size: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Spanning links of a leader and a block of its members, and the members without a path to the leader."""
    links = unit_links(ids, sets, num, den, size) if len(ids) > 1 else []
    forest = _Forest()
    for a, b in links:
        forest.link(a, b)
    return links, [int(x) for x in ids if forest.find(int(x)) != forest.find(leader)]


def _units(work: DataFrame, unit: list[str], k: int, done, schema: str) -> DataFrame:
    """``done`` of each unit's (keys, rows, sets); rows are dictionaries without the text. Units come whole and in order."""
    columns = [c for c in work.columns if c != "text"]
    work = work.repartition(*unit).sortWithinPartitions(*unit, "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, sets = None, [], []
        for pdf in batches:
            for row in zip(*[pdf[c] for c in columns], pdf["text"], strict=True):
                r = dict(zip(columns, row[:-1], strict=True))
                key = tuple(r[c] for c in unit)
                if key != now:
                    if now is not None:
                        yield done(now, rows, sets)
                    now, rows, sets = key, [], []
                rows.append(r)
                sets.append(shingle_set(row[-1], k))
        if now is not None:
            yield done(now, rows, sets)

    return work.mapInPandas(run, schema)


def _with_texts(dealt: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``dealt`` with the text of each node. nodes: (node, rep, h); docs: (doc_id, text, h). One row of a repeated one is taken."""
    need = dealt.select("node").distinct().join(nodes.select("node", "rep", "h"), "node")
    need = staged(need, "needed")
    texts = maybe_in(docs, "doc_id", need.select(F.col("rep").alias("doc_id"))).groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    placed = dealt.join(need, "node")
    # the same join at every size: the members grow with the input, so they must not count on being broadcast
    return placed.join(texts.select(F.col("doc_id").alias("rep"), "h", "text").hint("merge"), ["rep", "h"]).drop("rep", "h")


def near_links(docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """(a, b): links that connect what is linked. nodes: (node, rep, h, n, keys), staged; docs: (doc_id, text, h)."""
    keys = nodes.select("node", F.explode("keys").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("most"), F.count("*").alias("rows"))
    leaders = staged(leaders.where("leader <> most").select("key", "leader", "rows"), "leaders")
    members = keyed_join(keys, leaders, "key", "rows").select("leader", "node").where("leader <> node").distinct()
    members = staged(members.join(nodes.select("node", "n"), "node"), "members")
    blocks = members.groupBy("leader").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("rows")
    )
    dealt = keyed_join(members, blocks, "leader", "rows").withColumn("block", F.pmod(F.xxhash64("node", "leader"), F.col("blocks")).cast("int")).select("leader", "blocks", "block", "node", "n")
    heads = dealt.select("leader", "blocks", "block").distinct().withColumn("node", F.col("leader")).withColumn("n", F.lit(0).cast("bigint"))
    size = bands * rows

    def star(key: tuple, rows: list[dict], sets: list[np.ndarray]) -> pd.DataFrame:
        links, fails = star_links(key[0], np.array([r["node"] for r in rows]), sets, num, den, size)
        left = [(x, key[0], key[1]) for x in fails] if rows[0]["blocks"] > 1 else []
        return pd.DataFrame([(a, b, None) for a, b in links] + left, columns=["a", "b", "block"]).astype({"a": "int64", "b": "int64", "block": "Int64"})

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "h")
    first = staged(_units(_with_texts(dealt.union(heads), nodes, texts), ["leader", "block"], k, star, "a bigint, b bigint, block int"), "stars")
    links = first.where("block IS NULL").select("a", "b")
    fails = first.where("block IS NOT NULL").select(F.col("a").alias("node"), F.col("b").alias("leader"), "block").distinct()
    if fails.isEmpty():
        return links

    # members that a star did not connect meet the members of the other blocks
    fails = fails.join(members, ["leader", "node"])
    sides = fails.groupBy("leader").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("sides"))
    group = F.pmod(F.xxhash64("leader", "node"), F.col("sides")).cast("int")
    ours = dealt.join(sides, "leader").join(fails.select("leader", "node", F.lit(True).alias("failed")), ["leader", "node"], "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    ours = staged(ours, "second")
    left = ours.where("failed").select("leader", group.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block", "node", "failed", F.lit(True).alias("asks")).where("other <> block")
    right = ours.select("leader", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"), F.col("block").alias("other"), "block", "node", "failed", F.lit(False).alias("asks"))

    def cross(key: tuple, rows: list[dict], sets: list[np.ndarray]) -> pd.DataFrame:
        asks, failed, block = (np.array([r[c] for r in rows]) for c in ("asks", "failed", "block"))
        # of two that failed one asks: that of the lower block
        meets = asks[:, None] & ~asks[None, :] & (~failed[None, :] | (block[:, None] < block[None, :]))
        links = unit_links(np.array([r["node"] for r in rows]), sets, num, den, size, meets | meets.T, ~failed) if meets.any() else []
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return links.union(_units(_with_texts(left.union(right), nodes, texts), ["leader", "side", "other"], k, cross, "a bigint, b bigint"))


def _classes(docs: DataFrame, k: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Staged rows (doc_id, n, digest, h) and classes (digest, node, rep, h, n, keys). docs: (doc_id, text, h)."""
    one = docs.withColumn("s", _sets(F.col("text"), k, bands, rows))
    base = staged(one.select("doc_id", F.col("s.n").alias("n"), F.col("s.digest").alias("digest"), F.col("s.keys").alias("keys"), "h"), "sets")
    linked = base.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    found = linked.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("rows"))
    # numbers that are unique, and fixed once they are written
    found = found.select("digest", F.monotonically_increasing_id().alias("node"), F.col("r.doc_id").alias("rep"), F.col("r.h").alias("h"), "n", "keys", "rows")
    return base.drop("keys"), staged(found, "classes")


def _components_of(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(digest, rows, first): of each class its number of rows and the least (rep, digest) of its component."""
    comps = components(edges).join(classes.select("node", F.struct("rep", "digest").alias("own")), "node").select("node", "component", "own")
    least = comps.groupBy("component").agg(F.min("own").alias("first"))
    in_groups = comps.join(least, "component").select(F.col("own.digest").alias("digest"), "first")
    return classes.select("digest", "rows", "rep").join(in_groups, "digest", "left").select("digest", "rows", F.coalesce("first", F.struct("rep", "digest")).alias("first"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Documents are linked if den * intersection >= num * union. By default, five words and a similarity of 0.8.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    base, classes = _classes(docs, k, bands, rows)
    linked = base.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    alone = base.where(F.col("digest").isNull() | F.col("doc_id").isNull())
    edges = near_links(docs, classes.drop("digest"), k, num, den, bands, rows)
    # the classes of one id are one node
    mark = F.xxhash64("digest")
    several = linked.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("doc_id")
    of_id = linked.select("doc_id", "digest").join(several, "doc_id").distinct().join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    edges = edges.union(of_id.join(of_id.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").select("node", "least"))
    of_class = _components_of(classes, edges).select("digest", "rows", F.col("first.rep").alias("component_id"))
    out = keyed_join(linked.select("doc_id", "n", "digest"), staged(of_class, "verdicts"), "digest", "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.union(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One document of each group, with the columns of ``docs``: the one with the least id, once if its row is repeated.

    Groups are of texts here, not of ids: texts of one id that aren't linked all stay. Rows without id stay.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    base, classes = _classes(texts, k, bands, rows)
    of_class = staged(_components_of(classes, near_links(texts, classes.drop("digest"), k, num, den, bands, rows)), "verdicts")
    linked = base.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    first = F.struct(F.col("doc_id").alias("rep"), "digest") == F.col("first")
    verdicts = keyed_join(linked.select("doc_id", "digest"), of_class, "digest", "rows").select("doc_id", first.cast("int").alias("kept"))
    verdicts = verdicts.union(base.where(F.col("digest").isNull() & F.col("doc_id").isNotNull()).select("doc_id", F.lit(1)))
    # ids whose rows do not simply all stay
    ids = staged(verdicts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("kept").alias("kept")).where("n > 1 OR kept = 0"), "dropped")
    names = [F.col(f"`{c}`") for c in docs.columns]
    asked = ids.select("doc_id")
    out = maybe_in(docs, "doc_id", asked, False).union(maybe_in(docs, "doc_id", asked).join(asked.hint("merge"), "doc_id", "left_anti").select(*names))
    repeated = ids.where("kept > 0").select("doc_id")
    if not repeated.isEmpty():  # sets are taken a second time only of rows that repeat an id
        own, taken, key = fresh(docs, "own_set", "taken", "same")
        same = maybe_in(docs, "doc_id", repeated).join(repeated, "doc_id", "left_semi").withColumn(own, _sets(F.col("text"), k, 1, 1)["digest"])
        chosen = of_class.select(F.col("first.rep").alias("doc_id"), F.col("first.digest").alias(own)).distinct().withColumn(taken, F.lit(True))
        same = same.join(chosen, ["doc_id", own], "left").where(F.col(taken) | F.col(own).isNull())
        same = same.withColumn(key, F.coalesce(own, F.md5(F.col("text").cast("binary")).cast("binary"))).dropDuplicates(["doc_id", key])
        out = out.union(same.select(*names))
    return out


def query(docs: DataFrame) -> DataFrame:
    """The contract's measure: three words, 0.85."""
    return near_duplicates(docs, k=3, num=85, den=100, bands=BANDS_85, rows=ROWS_85)
