"""Replay of entry state by window functions: segments between misses, gaps, snapshots, features, labels.

All windows are by key (or by key and segment, which the same partitioning satisfies): one exchange for the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import FEATURES, FREQUENCY_MAX, HISTORY, HOLDOUT, MIN_CLASS_RATE, RECENCY_BOUNDARIES, UINT32


def by_key() -> WindowSpec:
    return W.partitionBy("key").orderBy("timestamp_us", "ordinal")


def in_segment() -> WindowSpec:
    return W.partitionBy("key", "segment").orderBy("timestamp_us", "ordinal")


def with_segments(trace: DataFrame) -> DataFrame:
    """segment (1-based per key; one begins at the key's first record and at every miss), position in it, admission time
    (W2 to W5)."""
    first = F.row_number().over(by_key()) == 1
    out = trace.withColumn("segment", F.sum((first | ~F.col("hit")).cast("bigint")).over(by_key().rowsBetween(W.unboundedPreceding, 0)))
    out = out.withColumn("position", (F.row_number().over(in_segment()) - 1).cast("bigint"))
    return out.withColumn("admitted_us", F.first("timestamp_us").over(in_segment()))

def with_gaps(segments: DataFrame) -> DataFrame:
    """gap_ms to the access before in the segment (0 at its start, capped) and next_gap_us to the key's next access, whether
    hit or miss (-1: none) (W6, W7, T2)."""
    gap = F.expr("timestamp_us - lag(timestamp_us) OVER (PARTITION BY key, segment ORDER BY timestamp_us, ordinal)")
    out = segments.withColumn("gap_us", F.coalesce(gap, F.lit(0)))
    out = out.withColumn("gap_ms", F.least(F.expr("gap_us div 1000"), F.lit(UINT32))).drop("gap_us")
    return out.withColumn("next_gap_us", F.coalesce(F.lead("timestamp_us").over(by_key()) - F.col("timestamp_us"), F.lit(-1)))

def hashed_offset(seed: int = 1) -> Callable[[Column], Column]:
    """Offsets that depend on the key, the time and the seed only: the first 60 bits of an MD5, modulo the span."""

    def offset(span: Column) -> Column:
        text = F.concat_ws(":", F.col("key").cast("string"), F.col("timestamp_us").cast("string"), F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % F.greatest(span, F.lit(1))

    return offset

def with_offsets(gaps: DataFrame, max_recency_us: int, offset: Callable[[Column], Column] | None = None) -> DataFrame:
    """A snapshot at ``offset_us`` after each access, within its next gap and ``max_recency_us``."""
    span = F.when(F.col("next_gap_us") < 0, F.lit(max_recency_us)).otherwise(F.least("next_gap_us", F.lit(max_recency_us)))
    return gaps.withColumn("offset_us", (offset or hashed_offset())(span))

def with_features(snapshots: DataFrame) -> DataFrame:
    """The fourteen features at the snapshot (P5 to P10)."""
    accesses = F.col("position") + 1
    out = snapshots.withColumn("snapshot_us", F.col("timestamp_us") + F.col("offset_us")).withColumn("age_us", F.col("snapshot_us") - F.col("admitted_us"))
    for k in range(HISTORY):
        out = out.withColumn(f"delta_{k}", F.coalesce(F.lag("gap_ms", k).over(in_segment()), F.lit(0)).cast("float"))
    return (
        out.withColumn("recency_ms", F.expr("offset_us div 1000").cast("float"))
        .withColumn("age_ms", F.expr("age_us div 1000").cast("float"))
        .withColumn("accesses", accesses.cast("float"))
        .withColumn("frequency", F.least(accesses, F.lit(FREQUENCY_MAX)).cast("float"))
        .withColumn("reuse_rate", (accesses / (F.col("age_us") / 1e6 + 1)).cast("float"))
        .withColumn("size_bytes", F.col("size_bytes").cast("float"))
    )

def with_labels(features: DataFrame, boundary_us: int, end_us: Column) -> DataFrame:
    """y: 1 if the next access is further than the boundary after the snapshot, or never comes. kept: whether the trace lasts
    long enough to tell (P11, P12)."""
    censored = F.col("next_gap_us") < 0
    remaining = F.col("next_gap_us") - F.col("offset_us")
    out = features.withColumn("y", (censored | (remaining > boundary_us)).cast("int"))
    return out.withColumn("kept", ~censored | (F.col("snapshot_us") + boundary_us <= end_us))

def samples(trace: DataFrame, boundary_us: int, offset: Callable[[Column], Column] | None = None, max_recency_us: int | None = None) -> DataFrame:
    """The labelled table with all intermediate columns; rows with kept false are the censored drops."""
    end = trace.agg(F.max("timestamp_us").alias("end_us"))  # one row
    rows = with_offsets(with_gaps(with_segments(trace)), max_recency_us or RECENCY_BOUNDARIES * boundary_us, offset)
    return with_labels(with_features(rows).crossJoin(F.broadcast(end)), boundary_us, F.col("end_us"))

def reuse_quantiles(trace: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, gap_us): linear interpolation, truncated; 0 without any reuse."""
    gaps = trace.select((F.col("timestamp_us") - F.lag("timestamp_us").over(by_key())).alias("gap")).where("gap IS NOT NULL")
    got = gaps.agg(F.percentile("gap", F.array(*[F.lit(q) for q in quantiles])).alias("p"))
    pairs = F.arrays_zip(F.array(*[F.lit(q) for q in quantiles]).alias("q"), F.coalesce("p", F.array_repeat(F.lit(0.0), len(quantiles))).alias("v"))
    return got.select(F.explode(pairs).alias("x")).select(F.col("x.q").alias("quantile"), F.col("x.v").cast("bigint").alias("gap_us"))

def split(rows: DataFrame, fraction: float = HOLDOUT) -> DataFrame:
    """``rows`` with train: the first 1 - ``fraction`` by snapshot time, ties by ordinal."""
    from .trace import with_positions

    placed = with_positions(rows.drop("timestamp_us").withColumnRenamed("snapshot_us", "timestamp_us"), "place").withColumnRenamed("timestamp_us", "snapshot_us")
    n = placed.agg(F.count("*").alias("n"))
    return placed.crossJoin(F.broadcast(n)).withColumn("train", F.col("place") <= F.floor(F.col("n") * (1 - fraction))).drop("n")

def label_guard(rows: DataFrame) -> DataFrame:
    """(rows, positive_rate, verdict): why a table can't be trained on, or ok (A11, A12). rows: y, train."""
    out = rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.avg("y"), F.lit(0.0)).alias("positive_rate"),
        F.count_distinct(F.when(F.col("train"), F.col("y"))).alias("a"),
        F.count_distinct(F.when(~F.col("train"), F.col("y"))).alias("b"),
    )
    rate = F.col("positive_rate")
    verdict = (
        F.when(F.col("rows") == 0, "no rows")
        .when((rate < MIN_CLASS_RATE) | (rate > 1 - MIN_CLASS_RATE), "one-sided")
        .when((F.col("a") < 2) | (F.col("b") < 2), "single class")
        .otherwise("ok")
    )
    return out.select("rows", F.round("positive_rate", 6).alias("positive_rate"), verdict.alias("verdict"))

def holdout_auc(scored: DataFrame) -> DataFrame:
    """(auc) from (y, score): rank sums, ties sharing their mean rank (A13). Ties are grouped before anything is ordered, and the
    running rank is taken over ranges of scores, so no task sees all rows."""
    from .trace import with_positions

    groups = scored.groupBy("score").agg(F.sum("y").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    placed = with_positions(groups.withColumn("timestamp_us", F.col("score")).withColumn("ordinal", F.lit(0)), "g")
    # ranks: rows below plus half of the tie; rows below by a running sum over blocks of score groups
    blocks = placed.withColumn("block", F.expr("g div 10000"))
    sums = blocks.groupBy("block").agg(F.sum("n").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).select("block", "before")
    below = F.sum("n").over(W.partitionBy("block").orderBy("g").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    ranked = blocks.join(before, "block").withColumn("rank", F.col("before") + below + (F.col("n") + 1) / 2)
    a = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    pos, neg = F.col("p"), F.col("n") - F.col("p")
    return a.select(F.when((pos > 0) & (neg > 0), (F.col("r") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))

__all__ = ["FEATURES"]
