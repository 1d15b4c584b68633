"""A registry of model versions on disk: bodies and metadata, checked, published once, newest by name."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FEATURES, MODEL_FORMAT, MODEL_META

CHUNK, MAX_BODY, MAX_VERSION = 256 << 10, 64 << 20, 64


class Refused(ValueError):
    pass


def version_for(when: float | None = None) -> str:
    """The time in UTC with milliseconds, so that names sort as times do."""
    t = datetime.fromtimestamp(when, UTC) if when is not None else datetime.now(UTC)
    return f"{t:%Y%m%dT%H%M%S}{t.microsecond // 1000:03d}Z"


def problem(meta: dict, body: bytes | None) -> str | None:
    """Why a model can't be published."""
    version = meta.get("version") or ""
    if not version or len(version) > MAX_VERSION or any(c in version for c in "./\\") or version != os.path.basename(version):
        return f"version {version!r} is no bare name of up to {MAX_VERSION} characters"
    if meta.get("format") != MODEL_FORMAT:
        return f"format {meta.get('format')!r} is not {MODEL_FORMAT}"
    if meta.get("feature_count") != len(FEATURES):
        return f"{meta.get('feature_count')} features, not {len(FEATURES)}"
    if not (meta.get("boundary_seconds") or 0) > 0:
        return "the boundary is not positive"
    if not body:
        return "the body is empty"
    if len(body) > MAX_BODY or meta.get("size_bytes") != len(body):
        return f"size_bytes {meta.get('size_bytes')} is not the body's {len(body)} (of {MAX_BODY} at most)"
    if meta.get("sha256") != hashlib.sha256(body).hexdigest():
        return "sha256 is not the body's"
    return None


def describe(body: bytes, version: str, boundary_seconds: int, metrics: dict[str, str] | None = None, created_unix: int = 0) -> dict:
    return {
        "version": version, "format": MODEL_FORMAT, "size_bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "created_unix": created_unix,
        "feature_count": len(FEATURES), "boundary_seconds": boundary_seconds, "metrics": metrics or {},
    }


def messages(meta: dict, body: bytes) -> Iterable[tuple[dict | None, bytes | None]]:
    """The metadata, then the body in chunks."""
    yield meta, None
    for k in range(0, len(body), CHUNK):
        yield None, body[k : k + CHUNK]


def assembled(stream: Iterable[tuple[dict | None, bytes | None]]) -> tuple[dict, bytes]:
    """Metadata and body of a stream, or why it is malformed."""
    meta, body = None, bytearray()
    for m, chunk in stream:
        if m is not None:
            if meta is not None:
                raise Refused("metadata twice")
            meta = m
            if not 0 < meta["size_bytes"] <= MAX_BODY:
                raise Refused(f"a body of {meta['size_bytes']} bytes")
        else:
            if meta is None:
                raise Refused("a chunk before the metadata")
            body += chunk or b""
            if len(body) > meta["size_bytes"]:
                raise Refused("more bytes than announced")
    if meta is None:
        raise Refused("no metadata")
    if len(body) < meta["size_bytes"]:
        raise Refused("fewer bytes than announced")
    if hashlib.sha256(body).hexdigest() != meta["sha256"]:
        raise Refused("sha256 is not the body's")
    return meta, bytes(body)


class Registry:
    def __init__(self, folder: str) -> None:
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, version: str, kind: str) -> str:
        return os.path.join(self.folder, f"{version}.{kind}")

    def versions(self) -> list[str]:
        """Those with metadata; a body alone is no version."""
        return sorted(n.removesuffix(".meta") for n in os.listdir(self.folder) if n.endswith(".meta"))

    def latest(self) -> str:
        return max(self.versions(), default="")

    def publish(self, meta: dict, body: bytes) -> str:
        """Body first, metadata last, each under its name only when whole.

        A name is claimed by a link, which fails if it exists: of several publishers of one version one wins. A body that a broken
        attempt left counts as published if it is the same.
        """
        if why := problem(meta, body):
            raise Refused(why)
        for kind, data in (("model", body), ("meta", json.dumps(meta).encode())):
            path = self._path(meta["version"], kind)
            own = f"{path}.{uuid.uuid4().hex}.tmp"
            with open(own, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(own, path)
            except FileExistsError:
                with open(path, "rb") as f:
                    same = kind == "model" and f.read() == data
                if not same:
                    raise FileExistsError(f"version {meta['version']} exists") from None
            finally:
                os.remove(own)
        return meta["version"]

    def get(self, version: str = "") -> tuple[dict, bytes]:
        """The latest for an empty version."""
        version = version or self.latest()
        if not version or version not in self.versions():
            raise KeyError(f"no version {version!r}")
        with open(self._path(version, "meta"), "rb") as f:
            meta = json.load(f)
        with open(self._path(version, "model"), "rb") as f:
            return meta, f.read()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MODEL_META).json(os.path.join(self.folder, "*.meta")) if self.versions() else spark.createDataFrame([], MODEL_META)


def newest(metas: DataFrame, limit: int = 0) -> DataFrame:
    """Newest first; all for a limit of 0 or less."""
    out = metas.orderBy(F.desc("version"))
    return out.limit(limit) if limit > 0 else out


def invalid_reason(max_version: int = MAX_VERSION) -> Column:
    """M14 over a table of metadata; null: valid."""
    v = F.coalesce("version", F.lit(""))
    return (
        F.when((v == "") | (F.length(v) > max_version) | v.rlike(r"[./\\]"), "version")
        .when(~F.col("format").eqNullSafe(MODEL_FORMAT), "format").when(~F.col("feature_count").eqNullSafe(len(FEATURES)), "features")
        .when(~(F.coalesce("boundary_seconds", F.lit(0)) > 0), "boundary").when(~(F.coalesce("size_bytes", F.lit(0)).between(1, MAX_BODY)), "size")
    )


def compatible(metas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of a node and the newest version that it can load: same format and boundary (J7). nodes: node, format,
    boundary_seconds."""
    best = metas.groupBy("format", "boundary_seconds").agg(F.max("version").alias("version"))
    return nodes.join(best, ["format", "boundary_seconds"]).select("node", "version")
