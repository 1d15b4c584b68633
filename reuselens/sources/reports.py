"""Reports of runs: the flat record, its JSON and text forms, and the file that a sweep appends to."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The record of one run.
RUN = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("policy", "model_version", "requested")),
    *(T.StructField(c, T.LongType()) for c in ("requests", "keyspace", "warmup", "concurrency", "seed", "hits", "misses", "evictions", "rejections", "objects", "bytes_used", "capacity_bytes", "p50_us", "p99_us", "p999_us", "origin_latency_ns", "repeat")),
    *(T.StructField(c, T.DoubleType()) for c in ("object_hit", "byte_hit", "client_hit", "optimum", "evict_ns", "marginal_ns", "evictions_per_request")),
])
RATIOS = ("object_hit", "byte_hit", "client_hit", "optimum")


def round4(x: float) -> float:
    """Half away from zero."""
    return (1 if x >= 0 else -1) * int(abs(x) * 1e4 + 0.5) / 1e4


def record(values: dict) -> dict:
    """The record's fields in order, ratios to four places; what isn't known is left out."""
    return {f.name: round4(values[f.name]) if f.name in RATIOS else values[f.name] for f in RUN if values.get(f.name) is not None}


def as_json(values: dict) -> str:
    return json.dumps(record(values), indent=2)


def human(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if n < 1024:
            return f"{n:.0f} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} PiB"


def as_text(values: dict) -> str:
    """Sections of labelled lines."""
    v = record(values)
    line = lambda label, value: f"  {label:<22}{value}"
    out = ["workload", line("requests", v.get("requests", 0)), line("keyspace", v.get("keyspace", 0)), "cache", line("policy", v.get("policy", "") + (f" ({v['model_version']})" if v.get("model_version") else ""))]
    out += [line("used / capacity", f"{human(v.get('bytes_used', 0))} / {human(v.get('capacity_bytes', 0))}"), "hit ratios"]
    out += [line(c.replace("_", " "), f"{v[c]:.4f}") for c in RATIOS if c in v]
    if "optimum" in v and "object_hit" in v:
        out.append(line("gap to optimum", f"{100 * (v['object_hit'] - v['optimum']):+.2f} points"))
    out += ["latency", *[line(c, f"{v[c]} us") for c in ("p50_us", "p99_us", "p999_us") if c in v]]
    return "\n".join(out) + "\n"


def append(path: str, values: dict) -> None:
    with open(path, "a") as f:
        f.write(json.dumps(record(values)) + "\n")


def begin(path: str) -> None:
    """A sweep starts with a file that isn't there or is empty."""
    if os.path.exists(path) and os.path.getsize(path):
        raise FileExistsError(f"{path} holds runs already")


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)
