"""Offline optimum and exact LRU over position-ordered requests (pos, key)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_use(requests: DataFrame) -> DataFrame:
    """next_pos: the position of the key's next request; null: never."""
    return requests.withColumn("next_pos", F.lead("pos").over(W.partitionBy("key").orderBy("pos")))


def furthest_hits(next_uses: list[int | None], keys: list, capacity: int, start: int = 0) -> int:
    """Hits at index ``start`` or later when the resident object with the furthest next use goes.

    Each request enters, hit or miss. The heap is cleaned lazily: an entry counts only while it is its key's newest.
    """
    if capacity <= 0:
        return 0
    never = len(keys) + 1 << 40
    resident: dict = {}
    heap: list[tuple[int, int]] = []
    of: dict[int, object] = {}
    hits = 0
    for i, (k, u) in enumerate(zip(keys, next_uses, strict=True)):
        u = never + i if u is None else u
        if k in resident:
            hits += i >= start
        elif len(resident) >= capacity:
            while True:
                far = -heapq.heappop(heap)[0]
                victim = of.pop(far)
                if resident.get(victim) == far:
                    del resident[victim]
                    break
        resident[k] = u
        of[u] = k
        heapq.heappush(heap, (-u, i))
    return hits


def optimum(requests: DataFrame, capacity: int, start: int = 0, group: str | None = None) -> DataFrame:
    """(group, requests, hits): the optimum per group, each of which is one task's work in time order.

    A trace is one sequence, so a group is the unit of parallelism: deal by shard (see ``functions.hashing.shard_of``) to spread a
    large trace; without a group the whole trace is one task. Next uses come from a window, in parallel.
    """
    g = F.lit(0) if group is None else F.col(group)
    rows = next_use(requests).select(g.cast("bigint").alias("group"), "pos", "key", "next_pos")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        uses = [None if pd.isna(x) else int(x) for x in pdf["next_pos"]]
        hits = furthest_hits(uses, pdf["key"].tolist(), capacity, start)
        return pd.DataFrame({"group": [int(pdf["group"].iloc[0])], "requests": [max(0, len(pdf) - max(0, start))], "hits": [hits]})

    return rows.groupBy("group").applyInPandas(run, "group bigint, requests bigint, hits bigint")


class _Counts:
    """Prefix sums over places, in logarithmic time."""

    def __init__(self, n: int) -> None:
        self.tree = [0] * (n + 1)

    def add(self, i: int, x: int) -> None:
        while i < len(self.tree):
            self.tree[i] += x
            i += i & -i

    def upto(self, i: int) -> int:
        s = 0
        while i:
            s += self.tree[i]
            i -= i & -i
        return s


def distances(previous: list[int | None]) -> list[int | None]:
    """Distinct keys since the key's previous request, for requests 1, 2, ...; None for first requests."""
    counts, out = _Counts(len(previous)), []
    for i, p in enumerate(previous, 1):
        if p is None:
            out.append(None)
        else:
            out.append(counts.upto(i - 1) - counts.upto(p))
            counts.add(p, -1)
        counts.add(i, 1)
    return out


def stack_distances(requests: DataFrame, group: str | None = None) -> DataFrame:
    """(group, pos, key, distance): null for first requests. A request hits in an LRU of c objects iff distance < c."""
    g = F.lit(0) if group is None else F.col(group)
    w = W.partitionBy("group").orderBy("pos")
    rows = requests.select(g.cast("bigint").alias("group"), "pos", "key")
    if group is None:  # positions are dense already
        rows = rows.withColumn("i", F.col("pos"))
    else:
        rows = rows.withColumn("i", F.row_number().over(w).cast("bigint"))
    rows = rows.withColumn("previous", F.lag("i").over(W.partitionBy("group", "key").orderBy("pos")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        got = distances([None if pd.isna(x) else int(x) for x in pdf["previous"]])
        return pd.DataFrame({"group": pdf["group"], "pos": pdf["pos"], "key": pdf["key"], "distance": pd.array(got, dtype="Int64")})

    return rows.groupBy("group").applyInPandas(run, "group bigint, pos bigint, key bigint, distance bigint")


def miss_ratio_curve(distances_of: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, requests, hits) of exact LRU for several capacities in one aggregation."""
    n = F.count("*").alias("requests")
    hits = [F.count_if(F.coalesce(F.col("distance") < c, F.lit(False))).alias(f"h{c}") for c in capacities]
    one = distances_of.agg(n, *hits)
    pairs = F.array(*[F.struct(F.lit(c).cast("bigint").alias("capacity"), F.col(f"h{c}").alias("hits")) for c in capacities])
    return one.select("requests", F.explode(pairs).alias("x")).select("x.capacity", "requests", "x.hits")
