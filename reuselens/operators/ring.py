"""Consistent hashing: virtual nodes, successor lookup, bounded loads."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, unsigned_order, with_hash
from ..functions.scalars import http_status

REPLICAS, LOAD_FACTOR = 256, 1.25
#: Virtual nodes that a lookup may broadcast.
MAX_VNODES = 1_000_000


def vnodes(spark: SparkSession, nodes: list[str], replicas: int = REPLICAS) -> DataFrame:
    """(node, replica, key_hash) of name#0 to name#(replicas - 1); a name that comes twice counts once."""
    names = F.array(*[F.lit(n) for n in dict.fromkeys(nodes)]) if nodes else F.array().cast("array<string>")
    rows = spark.range(1).select(F.explode(names).alias("node")).select("node", F.explode(F.sequence(F.lit(0), F.lit(max(1, replicas) - 1))).alias("replica"))
    rows = rows.withColumn("label", F.concat("node", F.lit("#"), F.col("replica").cast("string")))
    return with_hash(rows, "label").drop("label")


def successor(key_hash: Column, ring: list[tuple[int, str]]) -> Column:
    """The node of the first virtual node at or after a key, around the end. ring: (signed hash, node)."""
    if len(ring) > MAX_VNODES:
        raise ValueError(f"{len(ring)} virtual nodes; use lookup_join")
    ordered = sorted((h & ((1 << 64) - 1), n) for h, n in ring)
    points, names = [h for h, _ in ordered], [n for _, n in ordered]

    @F.pandas_udf("string")
    def find(h: pd.Series) -> pd.Series:
        import numpy as np

        at = np.searchsorted(np.array(points, dtype="uint64"), h.to_numpy("int64").view("uint64"), side="left") % len(points)
        return pd.Series(np.array(names, dtype=object)[at])

    return find(key_hash)


def lookup(keys: DataFrame, ring: DataFrame, key_hash: str = "key_hash", out: str = "node") -> DataFrame:
    """Each key's node by binary search in the sorted ring (J2), whose size is checked before it goes to the tasks."""
    points = [(r["key_hash"], r["node"]) for r in ring.select("key_hash", "node").limit(MAX_VNODES + 1).collect()]
    if not points:
        raise ValueError("the ring has no nodes")
    return keys.withColumn(out, successor(F.col(key_hash), points))


def routed(requests: DataFrame, ring: DataFrame, key: str = "key", key_hash: str = "key_hash") -> DataFrame:
    """``requests`` with node and status (J10): an empty key is refused, and so is any other while there are no nodes."""
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    if ring.isEmpty():
        return requests.withColumn("node", F.lit(None).cast("string")).withColumn("status", http_status(F.when(empty, "InvalidArgument").otherwise("Unavailable")))
    out = lookup(requests, ring, key_hash)
    return out.withColumn("node", F.when(~empty, F.col("node"))).withColumn("status", F.when(empty, http_status(F.lit("InvalidArgument"))).otherwise(200))


def lookup_join(keys: DataFrame, ring: DataFrame, key_hash: str = "key_hash", out: str = "node", cells: int = 1 << 12) -> DataFrame:
    """The same for rings of any size: keys and virtual nodes meet by the leading bits of their hash; a key whose cell has no
    virtual node after it takes the first of a later cell."""
    bits = 64 - (cells - 1).bit_length()
    cell = lambda h: F.shiftrightunsigned(h, bits).cast("int")
    points = ring.select("node", F.col("key_hash").alias("h")).withColumn("cell", cell(F.col("h")))
    per = points.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct(unsigned_order(F.col("h")).alias("o"), "node"))).alias("points"))  # bounded by a cell's share of the ring
    first = per.select("cell", F.col("points")[0]["node"].alias("first"))
    every = ring.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell")).join(per, "cell", "left").join(first, "cell", "left")
    w = W.orderBy("cell").rowsBetween(1, W.unboundedFollowing)
    every = every.withColumn("after", F.first("first", ignorenulls=True).over(w)).withColumn("wrap", F.first("first", ignorenulls=True).over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    table = every.select("cell", "points", F.coalesce("after", "wrap").alias("beyond"))
    met = keys.withColumn("_cell", cell(F.col(key_hash))).join(table.withColumnRenamed("cell", "_cell"), "_cell")
    at = F.filter("points", lambda p: p["o"] >= unsigned_order(F.col(key_hash)))
    return met.withColumn(out, F.coalesce(F.get(at, F.lit(0))["node"], F.col("beyond"))).drop("_cell", "points", "beyond")


def load_capacity(total: int, nodes: int, factor: float = LOAD_FACTOR) -> int:
    return int((total + 1) / nodes * factor) + 1


class BoundedRing:
    """Picks the first node from a key's place on that has room, its home if none has."""

    def __init__(self, nodes: list[str], replicas: int = REPLICAS, factor: float = LOAD_FACTOR) -> None:
        self.nodes = list(dict.fromkeys(nodes))
        self.points = sorted((hash_key(f"{n}#{k}"), n) for n in self.nodes for k in range(replicas))
        self.hashes = [h for h, _ in self.points]
        self.load = dict.fromkeys(self.nodes, 0)
        self.factor = factor

    def pick(self, key: str) -> str:
        if not self.points:
            raise ValueError("the ring has no nodes")
        at = bisect.bisect_left(self.hashes, hash_key(key)) % len(self.points)
        home = chosen = self.points[at][1]
        if len(self.nodes) > 1:
            most = load_capacity(sum(self.load.values()), len(self.nodes), self.factor)
            chosen = next((n for k in range(len(self.points)) if self.load[n := self.points[(at + k) % len(self.points)][1]] < most), home)
        self.load[chosen] += 1
        return chosen

    def done(self, node: str) -> None:
        if self.load.get(node, 0) > 0:
            self.load[node] -= 1


def bounded_picks(events: DataFrame, nodes: list[str], replicas: int = REPLICAS, factor: float = LOAD_FACTOR, group: str | None = None) -> DataFrame:
    """(group, pos, key, node, load) for requests (pos, key, done_pos: null if still open), replayed in order by one task per group:
    a gateway's requests are one sequence."""
    g = F.lit("all") if group is None else F.col(group).cast("string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring, rows, open_until = BoundedRing(nodes, replicas, factor), [], []
        import heapq

        for pos, key, done in pdf.sort_values("pos")[["pos", "key", "done_pos"]].itertuples(index=False):
            while open_until and open_until[0][0] <= pos:
                ring.done(heapq.heappop(open_until)[1])
            node = ring.pick(key)
            rows.append((pos, key, node, ring.load[node]))
            if not pd.isna(done):
                heapq.heappush(open_until, (int(done), node))
        out = pd.DataFrame(rows, columns=["pos", "key", "node", "load"])
        out.insert(0, "group", pdf["group"].iloc[0])
        return out

    return events.select(g.alias("group"), "pos", "key", "done_pos").groupBy("group").applyInPandas(run, "group string, pos bigint, key string, node string, load bigint")
