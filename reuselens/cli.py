"""Command line: boundary, train, simulate and summarize. Exit codes: 0 done, 1 failed, 2 refused."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.model import dump
from .functions.scalars import boundary_seconds, duration_ns, size_bytes
from .operators import optimum, replay, simulator, stats, trace
from .operators.training import DegenerateLabels, train
from .sources import registry, reports, segments


def _trace(spark: SparkSession, folder: str):
    segments.segments(folder)  # says what is missing
    rows = segments.load(spark, folder)
    return rows.select("key", "timestamp_us", "size_bytes", "hit", F.xxhash64("file", "sequence", "pos").alias("ordinal"))


def boundary(spark: SparkSession, a: argparse.Namespace) -> int:
    for r in replay.reuse_quantiles(_trace(spark, a.traces), [0.5, 0.75, 0.9, 0.99]).collect():
        print(f"p{100 * r['quantile']:g}\t{r['gap_us'] / 1e6:.6f} s")
    return 0


def train_model(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        boundary_us = duration_ns(a.boundary) // 1000
        seconds = boundary_seconds(boundary_us)  # before anything is read
        fitted = train(_trace(spark, a.traces), boundary_us, seed=a.seed)
    except DegenerateLabels as e:
        print(f"{e}\ntry a boundary between the p90 and p99 that the command boundary shows", file=sys.stderr)
        return 2
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    body = dump(fitted.model).encode()
    if a.out:
        Path(a.out).write_bytes(body)
    if a.publish:
        meta = registry.describe(body, registry.version_for(), seconds, {"auc": f"{fitted.auc:.4f}", "rows": str(fitted.rows)})
        print(registry.Registry(a.publish).publish(meta, body))
    print(fitted.summary())
    return 0


def simulate(spark: SparkSession, a: argparse.Namespace) -> int:
    requests = trace.with_positions(_trace(spark, a.traces))
    run = simulator.simulate(requests, a.policy, size_bytes(a.capacity), a.shards)
    t = simulator.totals(run, a.warmup + 1).first().asDict()
    n, all_bytes = t["requests"] or 0, t["hit_bytes"] + t["miss_bytes"]
    size = requests.agg(F.avg("size_bytes")).first()[0] or 0
    best = optimum.optimum(requests, int(size_bytes(a.capacity) / size) if size else 0, a.warmup).first() if n else None
    values = {"policy": a.policy, "requests": n, "warmup": a.warmup, "hits": t["hits"], "misses": t["misses"], "evictions": t["evictions"], "capacity_bytes": size_bytes(a.capacity), "bytes_used": t["max_used_bytes"] or 0,
              "object_hit": t["hits"] / n if n else 0.0, "byte_hit": t["hit_bytes"] / all_bytes if all_bytes else 0.0, "optimum": best["hits"] / n if best else None}
    print(reports.as_json(values) if a.json else reports.as_text(values))
    return 0


def summarize(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = stats.run_gates(reports.runs(spark, a.file))
    if bad := rows.where("reason IS NOT NULL").select("reason").distinct().collect():
        print("runs that can't be used: " + ", ".join(r["reason"] for r in bad), file=sys.stderr)
        return 1
    stats.sweep_table(rows).orderBy("origin_latency_ns").show(truncate=False)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reuselens", description=__doc__)
    sub = p.add_subparsers(required=True)
    b = sub.add_parser("boundary")
    t = sub.add_parser("train")
    s = sub.add_parser("simulate")
    for x in (b, t, s):
        x.add_argument("--traces", required=True)
    t.add_argument("--boundary", default="10m")
    t.add_argument("--out")
    t.add_argument("--publish")
    t.add_argument("--seed", type=int, default=1)
    s.add_argument("--policy", default=simulator.DEFAULT_POLICY, choices=simulator.POLICIES)
    s.add_argument("--capacity", default="256MiB")
    s.add_argument("--shards", type=int, default=1)
    s.add_argument("--warmup", type=int, default=0)
    s.add_argument("--json", action="store_true")
    m = sub.add_parser("summarize")
    m.add_argument("file")
    for x, f in ((b, boundary), (t, train_model), (s, simulate), (m, summarize)):
        x.set_defaults(run=f)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("reuselens").getOrCreate()
    try:
        return a.run(spark, a)
    except (FileNotFoundError, FileExistsError, registry.Refused, segments.Corrupt) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
