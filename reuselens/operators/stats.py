"""Statistics of nodes, runs and sweeps (A1 to A20, J8, P15, P16, ST6, ST10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ratio

COUNTERS = ("hits", "misses", "hit_bytes", "miss_bytes", "evictions", "rejections", "evict_ns_sum", "evict_samples")
GAUGES = ("objects", "bytes_used", "capacity_bytes")


def mean_evict_ns() -> Column:
    return F.when(F.col("evict_samples") == 0, F.lit(0)).otherwise(F.expr("evict_ns_sum div evict_samples")).cast("bigint")


def merge(nodes: DataFrame, *by: str) -> DataFrame:
    """Sums of counters and gauges; policy and model_version, or mixed where nodes differ; the mean eviction from the sums (A1,
    A2)."""
    same = lambda c: F.when(F.count_distinct(c) > 1, "mixed").otherwise(F.max(c)).alias(c)
    out = nodes.groupBy(*by).agg(*[F.sum(c).cast("bigint").alias(c) for c in (*COUNTERS, *GAUGES)], same("policy"), same("model_version"))
    return out.withColumn("evict_ns_mean", mean_evict_ns())


def hit_ratios(stats: DataFrame) -> DataFrame:
    """A3, A4."""
    h, m, hb, mb = (F.col(c) for c in ("hits", "misses", "hit_bytes", "miss_bytes"))
    return stats.withColumn("object_hit", ratio(h, h + m)).withColumn("byte_hit", ratio(hb, hb + mb))


def window_delta(snapshots: DataFrame, node: str = "node", order: str = "seq") -> DataFrame:
    """Counters of each snapshot minus those of the one before it, gauges as they are; restarted tells that a counter fell (A5)."""
    w = W.partitionBy(node).orderBy(order)
    out = snapshots
    for c in COUNTERS:
        out = out.withColumn(f"_{c}", F.col(c) - F.lag(c).over(w))
    out = out.where(F.col(f"_{COUNTERS[0]}").isNotNull())
    fell = F.array_min(F.array(*[F.col(f"_{c}") for c in COUNTERS])) < 0
    out = out.select(node, order, fell.alias("restarted"), *[F.col(f"_{c}").alias(c) for c in COUNTERS], *GAUGES)
    return out.withColumn("evict_ns_mean", F.when(F.col("restarted"), F.lit(0)).otherwise(mean_evict_ns()).cast("bigint"))


def require_no_restart(delta: DataFrame, node: str = "node") -> DataFrame:
    fallen = [r[node] for r in delta.where("restarted").select(node).distinct().limit(10).collect()]
    if fallen:
        raise ValueError(f"counters fell; restarted: {fallen}")
    return delta


def _at_index(counts: DataFrame, quantiles: list[float], by: tuple[str, ...]) -> DataFrame:
    """Of counts (by, value, n) by value: the rows that hold index floor(q (n - 1)), with that index less the rows below as rest."""
    w = W.partitionBy(*by).orderBy("value")
    ranked = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    q = F.explode(F.array(*[F.lit(x) for x in quantiles])).alias("quantile")
    hit = ranked.select(*by, "value", "n", "upto", "total", q).withColumn("index", F.floor(F.col("quantile") * (F.col("total") - 1)))
    return hit.where((F.col("index") < F.col("upto")) & (F.col("index") >= F.col("upto") - F.col("n"))).select(*by, "quantile", "value", (F.col("index") - F.col("upto") + F.col("n")).alias("rest"))


def lower_quantiles(rows: DataFrame, column: str, quantiles: list[float], *by: str) -> DataFrame:
    """(by, quantile, value): the value at index floor(q (n - 1)) of the sorted whole-number values.

    By counts of values in two levels: blocks of neighbouring values first, about as many as a block has values, then the values
    of the blocks that hold an index. So no task sorts more than the square root of the range of values.
    """
    value = F.col(column).cast("bigint")
    span = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    bits = ((span["hi"] or 0) - (span["lo"] or 0)).bit_length() // 2
    counts = rows.where(value.isNotNull()).groupBy(*by, value.alias("v")).agg(F.count("*").alias("n")).withColumn("block", F.shiftright("v", bits))
    blocks = counts.groupBy(*by, F.col("block").alias("value")).agg(F.sum("n").alias("n"))
    held = _at_index(blocks, quantiles, by).withColumnRenamed("value", "block")
    inside = counts.join(held, [*by, "block"])
    below = F.sum("n").over(W.partitionBy(*by, "quantile").orderBy("v").rowsBetween(W.unboundedPreceding, -1))
    found = inside.withColumn("below", F.coalesce(below, F.lit(0))).where("rest >= below AND rest < below + n")
    return found.select(*by, "quantile", F.col("v").alias("value"))


def latency_split(rows: DataFrame, *by: str) -> DataFrame:
    """Whole means of all, cached and fetched requests (0 without any), and their difference (A9, A10). rows: ns, from_cache."""
    mean = lambda total, n: F.when(F.col(n) == 0, F.lit(0)).otherwise(F.expr(f"{total} div {n}")).cast("bigint")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("served"), F.count_if("from_cache").alias("cached"), F.coalesce(F.sum("ns"), F.lit(0)).alias("all_ns"),
        F.coalesce(F.sum(F.when(F.col("from_cache"), F.col("ns"))), F.lit(0)).alias("hit_ns"),
    ).withColumn("fetched", F.col("served") - F.col("cached")).withColumn("miss_ns", F.col("all_ns") - F.col("hit_ns"))
    out = out.withColumn("mean_ns", mean("all_ns", "served")).withColumn("mean_hit_ns", mean("hit_ns", "cached")).withColumn("mean_miss_ns", mean("miss_ns", "fetched"))
    return out.withColumn("marginal_ns", F.col("mean_miss_ns") - F.col("mean_hit_ns")).select(*by, "served", "cached", "mean_ns", "mean_hit_ns", "mean_miss_ns", "marginal_ns")


def derived(stats: DataFrame) -> DataFrame:
    """Per-request figures of a window: evictions per request, mean object size, capacity in objects."""
    requests = F.col("hits") + F.col("misses")
    size = ratio(F.col("bytes_used").cast("double"), F.col("objects"))
    out = hit_ratios(stats).withColumn("evictions_per_request", ratio(F.col("evictions").cast("double"), requests)).withColumn("mean_size", size)
    return out.withColumn("capacity_objects", F.when(F.col("mean_size") > 0, F.floor(F.col("capacity_bytes") / F.col("mean_size"))).otherwise(F.lit(0)).cast("bigint"))


def lower_median(column: str) -> Column:
    """Element floor((n - 1) / 2) of the sorted values of a group of repeated runs (A16), from counts of distinct values that
    tasks merge."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})")


def sweep_table(runs: DataFrame, policies: tuple[str, str] = ("lru", "lrb")) -> DataFrame:
    """Per latency with both policies: medians over the repeats, and the break-even (A17). runs: origin_latency_ns, policy,
    object_hit, marginal_ns, evict_ns, evictions_per_request, p99_us."""
    old, new = policies
    columns = ("object_hit", "marginal_ns", "evict_ns", "evictions_per_request", "p99_us")
    medians = runs.groupBy("origin_latency_ns", "policy").agg(F.count("*").alias("runs"), *[lower_median(c).alias(c) for c in columns])
    x = medians.groupBy("origin_latency_ns").pivot("policy", [old, new]).agg(*[F.first(c).alias(c) for c in ("runs", *columns)])
    x = x.where(F.col(f"{old}_object_hit").isNotNull() & F.col(f"{new}_object_hit").isNotNull())
    gain = F.col(f"{new}_object_hit") - F.col(f"{old}_object_hit")
    cost = (F.col(f"{new}_evict_ns") - F.col(f"{old}_evict_ns")) * F.col(f"{new}_evictions_per_request")
    marginal = (F.col(f"{old}_marginal_ns") + F.col(f"{new}_marginal_ns")) / 2.0
    return x.select(
        "origin_latency_ns", F.col(f"{new}_runs").alias("runs"), F.col(f"{old}_evict_ns").alias("old_evict_ns"), F.col(f"{new}_evict_ns").alias("new_evict_ns"),
        F.col(f"{old}_p99_us").alias("old_p99_us"), F.col(f"{new}_p99_us").alias("new_p99_us"), F.col(f"{old}_object_hit").alias("old_hit"), F.col(f"{new}_object_hit").alias("new_hit"), F.round(gain * 10_000, 4).alias("gain_bp"), F.round(marginal, 4).alias("marginal_ns"),
        F.round(cost, 4).alias("spent_ns"), F.round(gain * marginal, 4).alias("saved_ns"), F.round(gain * marginal - cost, 4).alias("net_ns"),
        F.when(gain > 0, F.round(cost / gain / 1000.0, 4).cast("string")).otherwise("n/a").alias("breakeven_us"),
    )


def cost_fit(runs: DataFrame, least_ns: int = 0) -> DataFrame:
    """(slope, intercept) of the marginal cost of a miss over the origin's latency."""
    return runs.where(F.col("origin_latency_ns") >= least_ns).agg(F.regr_slope("marginal_ns", "origin_latency_ns").alias("slope"), F.regr_intercept("marginal_ns", "origin_latency_ns").alias("intercept"))


def counter_rates(samples: DataFrame, window: str, slide: str | None = None, *by: str) -> DataFrame:
    """(by, start, increase): the growth of a counter per time window; after a fall, the new value counts (ST6). samples: ts, value."""
    before = F.lag("value").over(W.partitionBy(*by).orderBy("ts"))
    grown = samples.withColumn("grown", F.when(before.isNull(), F.lit(0)).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before))
    return grown.groupBy(*by, F.window("ts", window, slide or window).alias("w")).agg(F.sum("grown").alias("increase")).select(*by, F.col("w.start").alias("start"), "increase")


#: Upper bounds of the histogram's buckets in seconds: twenty from 50 us, doubling, and infinity.
BUCKETS = [50e-6 * 2**k for k in range(19)]


def bucket_counts(rows: DataFrame, seconds: str, *by: str) -> DataFrame:
    """(by, bucket, n): rows per bucket number, 1 to 20."""
    number = sum([F.when(F.col(seconds) > b, 1).otherwise(0) for b in BUCKETS], F.lit(1))
    return rows.groupBy(*by, number.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def histogram_quantiles(counts: DataFrame, quantiles: list[float], *by: str) -> DataFrame:
    """(by, quantile, value): linear interpolation in the first bucket that the rank reaches; the last finite bound beyond (ST10)."""
    w = W.partitionBy(*by).orderBy("bucket")
    upper = F.array(*[F.lit(b) for b in BUCKETS])
    x = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    x = x.select("*", F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("quantile"))
    rank = F.col("quantile") * F.col("total")
    x = x.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    high = F.get(upper, F.col("bucket") - 1)
    low = F.when(F.col("bucket") > 1, F.get(upper, F.col("bucket") - 2)).otherwise(F.lit(0.0))
    value = F.when(F.col("bucket") > len(BUCKETS), F.lit(BUCKETS[-1])).otherwise(low + (high - low) * (rank - (F.col("upto") - F.col("n"))) / F.col("n"))
    return x.select(*by, "quantile", value.alias("value"))


def single_flight(misses: DataFrame, fetch_us: int) -> DataFrame:
    """fetched: whether a miss starts a fetch; misses of a key while one is under way share it.

    Fetches of one key don't overlap, so whether a miss starts one depends on the last fetch alone. A task reads its keys' misses in
    order, batch by batch, and carries only that.
    """
    rows = misses.select(F.col("key").cast("bigint").alias("key"), F.col("timestamp_us").cast("bigint").alias("timestamp_us"), F.col("ordinal").cast("bigint").alias("ordinal"))
    rows = rows.repartition("key").sortWithinPartitions("key", "timestamp_us", "ordinal")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, until = object(), 0  # no key yet, not even null
        for pdf in batches:
            fetched = []
            for key, t in zip(pdf["key"].astype("Int64").astype(object).where(pdf["key"].notna(), None).tolist(), pdf["timestamp_us"].tolist(), strict=True):
                new = key != now or t >= until
                if new:
                    now, until = key, t + fetch_us
                fetched.append(new)
            yield pdf.assign(fetched=fetched)

    return rows.mapInPandas(fold, "key bigint, timestamp_us bigint, ordinal bigint, fetched boolean")


def threshold_gate(report: DataFrame, hit_floor: float = 0.0, p99_ceiling_ns: int = 0) -> DataFrame:
    """violations: all thresholds that a run misses; 0 disables one."""
    low = F.when(F.lit(hit_floor > 0) & (F.col("object_hit") < hit_floor), F.lit("object_hit"))
    slow = F.when(F.lit(p99_ceiling_ns > 0) & (F.col("p99_ns") > p99_ceiling_ns), F.lit("p99"))
    return report.withColumn("violations", F.array_compact(F.array(low, slow)))


def run_gates(runs: DataFrame) -> DataFrame:
    """reason: why a sweep's run can't be used, or null."""
    reason = (
        F.when(F.col("policy") == "mixed", "mixed policies").when(F.col("policy") != F.col("requested"), "other policy")
        .when((F.col("policy") == "lrb") & (F.coalesce("model_version", F.lit("")) == ""), "no model")
        .when(F.col("model_version") == "mixed", "mixed models").when(F.abs(F.col("object_hit") - F.col("client_hit")) >= 0.005, "client disagrees")
    )
    return runs.withColumn("reason", reason)


def metrics_long(stats: DataFrame, node: str = "node") -> DataFrame:
    """(node, metric, kind, value): counters end in _total, the rest are gauges."""
    long = stats.unpivot([node], [F.col(c).cast("double").alias(f"cache_{c}_total") for c in COUNTERS] + [F.col(c).cast("double").alias(f"cache_{c}") for c in GAUGES], "metric", "value")
    return long.withColumn("kind", F.when(F.endswith("metric", F.lit("_total")), "counter").otherwise("gauge"))
