"""Structured Streaming forms of the stateful operators: entry state by key, windowed rates, model watch (ST1, ST4 to ST9)."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import MODEL_META

ENTRY = "key bigint, timestamp_us bigint, ordinal bigint, segment bigint, accesses bigint, gap_ms bigint"
STATE = T.StructType([T.StructField(c, T.LongType()) for c in ("segment", "accesses", "last_us", "expires_us")])


class EntryState(StatefulProcessor):
    """Segment, accesses and gap of each access of a key, carried over micro-batches (ST4).

    Within a batch a key's rows are taken in order of time and ordinal. A deadline is looked at when the key is read and at no
    other time (ST5), so it is part of the state and not left to the store.
    """

    def __init__(self, ttl_us: int = 0) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entry", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["timestamp_us", "ordinal"])
        segment, accesses, last, expires = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        out = []
        for now, ordinal, hit in zip(pdf["timestamp_us"].tolist(), pdf["ordinal"].tolist(), pdf["hit"].tolist(), strict=True):
            if not hit or accesses == 0 or expires and now >= expires:
                segment, accesses, gap = segment + 1, 1, 0
                expires = now + self.ttl_us if self.ttl_us else 0
            else:
                accesses, gap = accesses + 1, max(0, now - last) // 1000
            last = now
            out.append((key[0], now, ordinal, segment, accesses, gap))
        self.state.update((segment, accesses, last, expires))
        yield pd.DataFrame(out, columns=["key", "timestamp_us", "ordinal", "segment", "accesses", "gap_ms"])

    def close(self) -> None: ...


def entry_states(accesses: DataFrame, ttl_us: int = 0) -> DataFrame:
    register_pickle_by_value(sys.modules[__name__])  # stateful workers start without the files that Spark distributes
    return accesses.groupBy("key").transformWithStateInPandas(EntryState(ttl_us), outputStructType=ENTRY, outputMode="append", timeMode="none")


def capture(accesses: DataFrame, folder: str, checkpoint: str, node: str = "stream", **trigger):
    """The running query that writes a stream of records to segment files (ST1). A micro-batch that is run again replaces its files."""
    from ..sources.segments import SegmentSource

    def write(batch: DataFrame, number: int) -> None:
        own = f"{node}-b{number:09d}-"
        for n in os.listdir(folder) if os.path.isdir(folder) else ():
            if n.startswith(own):
                os.remove(os.path.join(folder, n))
        batch.sparkSession.dataSource.register(SegmentSource)
        batch.select("key_hash", "timestamp_us", "size_bytes", "hit").write.format("segments").option("node", own.rstrip("-")).mode("append").save(folder)

    return accesses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def windowed_hits(accesses: DataFrame, window: str, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Requests and hits per window of event time; rows later than the watermark are dropped by Spark and counted in its progress
    (ST6)."""
    ts = F.timestamp_micros("timestamp_us")
    rows = accesses.withColumn("ts", ts).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window, slide or window).alias("w")).agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits")).select(F.unix_micros("w.start").alias("start_us"), "requests", "hits")


def model_events(spark: SparkSession, folder: str, since: str = "") -> DataFrame:
    """A stream of published versions after ``since``, those that are there already first (ST7)."""
    return spark.readStream.schema(MODEL_META).option("pathGlobFilter", "*.meta").json(folder).where(F.col("version") > since)


def installer(fits: Callable[[dict], str | None], fetch: Callable[[str], tuple[dict, bytes]], load: Callable[[bytes, dict], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of a batch's versions the newest is checked, fetched, checked again, loaded; a failure is counted and
    the stream goes on (ST9)."""

    def install(batch: DataFrame, number: int) -> None:
        newest = batch.orderBy(F.desc("version")).limit(1).collect()
        if not newest:
            return
        announced = newest[0].asDict(recursive=True)
        try:
            if why := fits(announced):
                raise ValueError(why)
            meta, body = fetch(announced["version"])
            if why := fits(meta):
                raise ValueError(why)
            load(body, meta)
            install.loads += 1
        except Exception as e:  # noqa: BLE001  whatever is wrong with one version, later ones must be seen
            install.failures.append(f"{announced['version']}: {e}")

    install.loads, install.failures = 0, []
    return install


def backoff(lived_s: float, last_s: float, least: float = 1.0, most: float = 30.0) -> float:
    """Seconds to wait before the next attempt: doubled each time, from the start again after a stream that lived long (ST8)."""
    return least if lived_s >= most or last_s <= 0 else min(most, 2 * last_s)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


