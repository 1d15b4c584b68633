"""Scalar functions: durations, sizes, ratios, the origin's object sizes and latencies, status codes."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import unsigned, with_hash

# fixed values
NANOS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
SIZES = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "kib": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "mib": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "gib": 1 << 30, "t": 1 << 40, "tb": 1 << 40, "tib": 1 << 40}
HTTP_OF = {"InvalidArgument": 400, "NotFound": 404, "ResourceExhausted": 429, "Unavailable": 503, "DeadlineExceeded": 504, "Canceled": 499}
SOURCES = {0: "unknown", 1: "cache", 2: "origin"}
UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB")
MAX_INT64, MAX_UINT32 = (1 << 63) - 1, (1 << 32) - 1

_PART = re.compile(r"(\d*)(?:\.(\d*))?(ns|us|µs|μs|ms|s|m|h)")


def duration_ns(text: str) -> int:
    """Signed sums of decimal numbers with units; digits beyond the nanosecond are cut; 0 may stand alone."""
    sign, rest = (-1, text[1:]) if text[:1] == "-" else (1, text[1:] if text[:1] == "+" else text)
    if rest == "0":
        return 0
    total, at = 0, 0
    while at < len(rest):
        m = _PART.match(rest, at)
        if not m or not (m[1] or m[2]):
            raise ValueError(f"not a duration: {text!r}")
        unit = NANOS[m[3]]
        total += int(m[1] or 0) * unit + (int(m[2]) * unit // 10 ** len(m[2]) if m[2] else 0)
        at = m.end()
    if not rest or total > MAX_INT64 + (sign < 0):
        raise ValueError(f"not a duration: {text!r}")
    return sign * total


def size_bytes(text: str) -> int:
    """A positive whole number with an optional unit; all units are powers of 1024."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].lower() not in SIZES:
        raise ValueError(f"not a size: {text!r}")
    n = int(m[1]) * SIZES[m[2].lower()]
    if not 0 < n <= MAX_INT64:
        raise ValueError(f"not a size: {text!r}")
    return n


def ttl_seconds(text: str) -> int:
    """Whole seconds from 1 to what 32 bits hold."""
    seconds = duration_ns(text) // NANOS["s"]
    if not 1 <= seconds <= MAX_UINT32:
        raise ValueError(f"a time to live is from 1 s to {MAX_UINT32} s, not {text}")
    return seconds


def boundary_seconds(boundary_us: int) -> int:
    """P13."""
    if boundary_us % 1_000_000 or not 1 <= boundary_us // 1_000_000 <= MAX_UINT32:
        raise ValueError(f"a boundary is a whole number of seconds, not {boundary_us} us")
    return boundary_us // 1_000_000


T = TypeVar("T")


def setting(name: str, default: T, read: Callable[[str], T], strict: bool = False, warn: Callable[[str], None] = print) -> T:
    """An environment setting; a malformed one gives the default and a warning, or an error if ``strict``."""
    text = os.environ.get(name, "")
    if not text:
        return default
    try:
        return read(text)
    except ValueError as e:
        if strict:
            raise
        warn(f"{name}={text!r} ignored: {e}")
        return default


def ratio(num: Column, den: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def clamped_ratio(num: Column, den: Column, least: float = 1e-9) -> Column:
    """X14."""
    return num / F.greatest(den.cast("double"), F.lit(least))


def human_bytes(n: Column, units: tuple[str, ...] = UNITS) -> Column:
    """One decimal and a unit of 1024 steps, the last one without end; whole bytes below.

    Rounded as printf does: the half of the double's exact value to even. Whole part and rest times ten are exact.
    """
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        v = n / float(1 << 10 * k)
        tenths = F.rint((v - F.floor(v)) * 10).cast("int")
        text = F.concat((F.floor(v) + F.when(tenths == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= 1 << 10 * k, text).otherwise(out)
    return out


def http_status(code: Column) -> Column:
    """X5."""
    known = F.create_map(*[F.lit(x) for pair in HTTP_OF.items() for x in pair])
    return F.coalesce(known[code], F.lit(500))


def source_name(code: Column) -> Column:
    """X6."""
    return F.when(code == 1, "cache").when(code == 2, "origin").otherwise("unknown")


def to_ns(text: Column) -> Column:
    """0, or a whole number of ns, us, ms or s (X12); null otherwise."""
    n, unit = F.regexp_extract(text, r"^([0-9]+)(ns|us|ms|s)$", 1), F.regexp_extract(text, r"^([0-9]+)(ns|us|ms|s)$", 2)
    scale = F.when(unit == "ns", 1).when(unit == "us", 1_000).when(unit == "ms", 1_000_000).when(unit == "s", 1_000_000_000)
    return F.when(text == "0", F.lit(0)).when(n != "", n.cast("bigint") * scale).cast("bigint")


def with_origin_size(df: DataFrame, key: str = "key", out: str = "origin_size", least: int = 512, most: int = 65_536, alpha: float = 1.5) -> DataFrame:
    """A Pareto size drawn by the hash of the key and "#size" (X8)."""
    hashed = with_hash(df.withColumn("_k", F.concat(F.col(key), F.lit("#size"))), "_k", "_h")
    u = (F.shiftrightunsigned("_h", 11) + 1).cast("double") / float(1 << 53)
    size = F.lit(float(least)) * F.pow(F.lit(1.0) / u, F.lit(1.0 / alpha))
    return hashed.withColumn(out, F.greatest(F.lit(least), F.least(F.lit(most), F.floor(size))).cast("bigint")).drop("_k", "_h")


def with_origin_latency(df: DataFrame, key: str = "key", out: str = "origin_latency_ns", latency_ns: int = 2_000_000, jitter_ns: int = 1_000_000) -> DataFrame:
    """latency plus the unsigned hash of the key and "#latency" modulo the jitter; no jitter: latency."""
    if jitter_ns <= 0:
        return df.withColumn(out, F.lit(latency_ns).cast("bigint"))
    hashed = with_hash(df.withColumn("_k", F.concat(F.col(key), F.lit("#latency"))), "_k", "_h")
    return hashed.withColumn(out, (F.lit(latency_ns) + (unsigned(F.col("_h")) % F.lit(jitter_ns)).cast("bigint")).cast("bigint")).drop("_k", "_h")


def zipf_requests(spark, requests: int, keyspace: int, exponent: float = 1.1, seed: int = 1) -> DataFrame:
    """(pos, key, rank): P(rank k) proportional to (1 + k)^-exponent, by inverting the distribution at hashed uniforms.

    The cumulative weights are keyspace numbers, built once per task from the rule; the requests are dealt by range.
    """
    import numpy as np
    import pandas as pd

    def draw(batches):
        cumulative = np.cumsum((1.0 + np.arange(keyspace)) ** -exponent)
        for pdf in batches:
            u = pdf["u"].to_numpy("float64") / float(1 << 52)
            rank = np.searchsorted(cumulative, u * cumulative[-1], side="right").clip(0, keyspace - 1)
            yield pd.DataFrame({"pos": pdf["pos"], "key": [f"key-{k}" for k in rank], "rank": rank})

    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))
    rows = spark.range(1, requests + 1).select(F.col("id").alias("pos"), F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").alias("u"))
    return rows.mapInPandas(draw, "pos bigint, key string, rank bigint")
