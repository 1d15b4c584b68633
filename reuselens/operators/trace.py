"""Canonical traces and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import staged


def events_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as accesses: the user is the object; a signup is a miss, that is, an admission."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"),
        (F.lit(512) + F.floor(F.col("value") * 100)).cast("bigint").alias("size_bytes"),
        (F.col("event_type") != "signup").alias("hit"),
        F.col("event_id").alias("ordinal"),
    )


def parts_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as accesses to parts by ship date; ties by order and line."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select(
        F.col("l_partkey").alias("key"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("timestamp_us"),
        (F.col("l_quantity") * 64).cast("bigint").alias("size_bytes"),
        F.lit(True).alias("hit"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
    )


def with_positions(trace: DataFrame, name: str = "pos") -> DataFrame:
    """``trace`` with its 1-based place in order of time and ordinal.

    Rows are dealt by range and numbered within each part from the sum of the parts before it: no task sees all rows. Only a
    count per part comes to the driver.
    """
    parts = trace.repartitionByRange("timestamp_us", "ordinal").withColumn("_part", F.spark_partition_id())
    parts = staged(parts, "ranged")
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    place = F.row_number().over(W.partitionBy("_part").orderBy("timestamp_us", "ordinal"))
    start = F.element_at(F.array(*[F.lit(x) for x in before or [0]]), F.col("_part") + 1)
    return parts.withColumn(name, (place + start).cast("bigint")).drop("_part")


def duration(trace: DataFrame) -> DataFrame:
    """(records, duration_us): 0 for an empty trace."""
    return trace.agg(F.count("*").alias("records"), F.coalesce(F.max("timestamp_us") - F.min("timestamp_us"), F.lit(0)).alias("duration_us"))


def accounting(trace: DataFrame) -> DataFrame:
    """(hit, records, bytes)."""
    return trace.groupBy("hit").agg(F.count("*").alias("records"), F.sum("size_bytes").alias("bytes"))


def offered(trace: DataFrame, capacity: int, flush_us: int) -> DataFrame:
    """Bounded capture: per key and flush interval the first ``capacity`` records (rounded up to a power of two, 2 at least)
    are kept, newer ones dropped and counted (T18, ST3)."""
    from ..functions.hashing import pow2

    size = max(2, pow2(capacity, 2))
    w = W.partitionBy("key", "flush").orderBy("timestamp_us", "ordinal")
    numbered = trace.withColumn("flush", F.expr(f"timestamp_us div {flush_us}")).withColumn("n", F.row_number().over(w))
    return numbered.groupBy("flush").agg(F.count_if(F.col("n") <= size).alias("pushed"), F.count_if(F.col("n") > size).alias("dropped"))


def striped(trace: DataFrame, workers: int) -> DataFrame:
    """Requests by worker: worker w takes positions w, w + c, ...."""
    return trace.withColumn("worker", F.pmod(F.col("pos") - 1, F.lit(workers)).cast("bigint"))
