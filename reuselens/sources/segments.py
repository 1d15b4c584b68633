"""Trace segment files: frames of a length and a batch message, as a Spark data source that reads and writes them.

A batch message has node_id (1), sequence (2) and repeated records (3); a record has key_hash (1), timestamp_us (2), size_bytes
(3) and hit (4), in protobuf's encoding. Files are dealt to tasks one by one; what a torn last frame held is left out in the
tolerant mode and an error in the strict one.

    spark.dataSource.register(SegmentSource)
    spark.read.format("segments").option("mode", "PERMISSIVE").load(folder)
    df.write.format("segments").mode("append").save(folder)
"""

from __future__ import annotations

import json
import os
import time
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.hashing import MASK, signed
from ..schema import SEGMENT_RECORD

SUFFIX, OPEN_SUFFIX = ".trace", ".partial"
BATCH, SEGMENT_BYTES, MAX_AGE_US = 4096, 32 << 20, 60_000_000


class Corrupt(ValueError):
    """A frame that can't be read."""


class Torn(Corrupt):
    """The file ends inside a frame."""


def put_varint(x: int) -> bytes:
    x &= MASK
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def varint(data: bytes, at: int) -> tuple[int, int]:
    """Value and the place after it."""
    x = shift = 0
    while True:
        if at >= len(data):
            raise Torn("a number is cut off")
        if shift > 63:
            raise Corrupt("a number is too long")
        b = data[at]
        at += 1
        x |= (b & 0x7F) << shift
        if b < 0x80:
            return x & MASK, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            if at + n > len(data):
                raise Corrupt("a field is longer than its message")
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise Corrupt(f"wire type {kind}")
        yield tag >> 3, value


Record = tuple[int, int, int, bool]


def decode_batch(data: bytes) -> tuple[str, int, list[Record]]:
    node, sequence, records = "", 0, []
    for number, value in _fields(data):
        if number == 1:
            node = value.decode()
        elif number == 2:
            sequence = signed(value)
        elif number == 3:
            r = {1: 0, 2: 0, 3: 0, 4: 0} | dict(_fields(value))
            records.append((signed(r[1]), signed(r[2]), r[3] & 0xFFFFFFFF, bool(r[4])))
    return node, sequence, records


def encode_batch(node: str, sequence: int, records: list[Record]) -> bytes:
    def number(field: int, x: int) -> bytes:
        return put_varint(field << 3) + put_varint(x) if x else b""

    def block(field: int, data: bytes) -> bytes:
        return put_varint(field << 3 | 2) + put_varint(len(data)) + data

    out = [block(1, node.encode()) if node else b"", number(2, sequence)]
    out += [block(3, number(1, k) + number(2, t) + number(3, s) + number(4, int(h))) for k, t, s, h in records]
    return b"".join(out)


def frame(message: bytes) -> bytes:
    return put_varint(len(message)) + message


def frames(data: bytes, strict: bool = False, name: str = "") -> Iterator[bytes]:
    """The whole frames; a corrupt or cut-off tail is dropped with a warning, or an error if ``strict``."""
    at = 0
    while at < len(data):
        try:
            n, start = varint(data, at)
            if start + n > len(data):
                raise Torn(f"the frame at byte {at} has {len(data) - start} of {n} bytes")
        except Corrupt as e:
            if strict:
                raise type(e)(f"{name}: {e}") from e
            warnings.warn(f"{name}: {e}; what follows byte {at} is dropped", stacklevel=2)
            return
        yield data[start : start + n]
        at = start + n


def batches(data: bytes, strict: bool = False, name: str = "") -> Iterator[tuple[str, int, list[Record]]]:
    at = 0
    for message in frames(data, strict, name):
        try:
            yield decode_batch(message)
        except (Corrupt, UnicodeDecodeError) as e:  # a whole frame that can't be decoded is no torn tail
            raise Corrupt(f"{name}: the frame before byte {at} can't be decoded: {e}") from e
        at += len(message)


def segments(folder: str) -> list[str]:
    """Finished segments in the order of their names (S1); none is an error that says what is there."""
    names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    found = [os.path.join(folder, n) for n in names if n.endswith(SUFFIX)]
    if not found:
        still = sum(n.endswith(OPEN_SUFFIX) for n in names)
        raise FileNotFoundError(f"no {SUFFIX} files in {folder}" + (f"; {still} {OPEN_SUFFIX} still open" if still else ""))
    return found


@dataclass
class _File(InputPartition):
    path: str


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.strict = options["path"].removeprefix("file://"), options.get("mode", "PERMISSIVE").upper() == "FAILFAST"

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in segments(self.folder)]

    def read(self, partition: _File) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        with open(partition.path, "rb") as f:
            data = f.read()
        for node, sequence, records in batches(data, self.strict, name):
            for pos, r in enumerate(records):
                yield (name, node, sequence, pos, *r)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]
    records: int


class SegmentWriter(DataSourceWriter):
    """Batches of at most ``batch`` records; a file is finished at ``segmentBytes``, or ``maxAgeUs`` after it was opened. Files get their name when the job commits, so
    readers see whole segments only (S7, S8)."""

    def __init__(self, options: dict, schema, overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"].removeprefix("file://"), overwrite
        self.node = options.get("node", "spark")
        self.batch, self.segment_bytes = int(options.get("batch", BATCH)), int(options.get("segmentbytes", options.get("segmentBytes", SEGMENT_BYTES)))
        self.max_age_us = int(options.get("maxageus", options.get("maxAgeUs", MAX_AGE_US)))
        self.columns = [schema.fieldNames().index(c) for c in ("key_hash", "timestamp_us", "size_bytes", "hit")]
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        files: list[tuple[str, str]] = []
        held: list[Record] = []
        out, size, total, sequence, opened = None, 0, 0, 0, 0.0

        def drain() -> None:
            nonlocal out, size, sequence, held, opened
            if not held:
                return
            if out is None:
                name = os.path.join(self.folder, f"{self.node}-{shard:05d}-{len(files):06d}-{uuid.uuid4().hex}")
                files.append((name + OPEN_SUFFIX, name + SUFFIX))
                out, size = open(name + OPEN_SUFFIX, "wb"), 0  # noqa: SIM115
                opened = time.monotonic()
            size += out.write(frame(encode_batch(f"{self.node}/{shard}", sequence, held)))
            sequence, held = sequence + 1, []
            if size >= self.segment_bytes or (time.monotonic() - opened) * 1e6 >= self.max_age_us:
                out.close()
                out = None

        for row in rows:
            k, t, s, h = (row[c] for c in self.columns)
            held.append((int(k), int(t), int(s), bool(h)))
            total += 1
            if len(held) >= self.batch:
                drain()
        drain()
        if out is not None:
            out.close()
        return _Written(files, total)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for n in os.listdir(self.folder):
                if n.endswith((SUFFIX, ".written")):
                    os.remove(os.path.join(self.folder, n))
        for m in messages:
            for temporary, final in m.files if m else ():
                os.replace(temporary, final)
        done = [m for m in messages if m]
        stats = {"records": sum(m.records for m in done), "segments": sum(len(m.files) for m in done)}
        with open(os.path.join(self.folder, f"{self.node}-{uuid.uuid4().hex}.written"), "w") as f:
            json.dump(stats, f)

    def abort(self, messages: list) -> None:
        for m in messages:
            for temporary, _ in m.files if m else ():
                if os.path.exists(temporary):
                    os.remove(temporary)


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self):
        return SEGMENT_RECORD

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(dict(self.options), schema, overwrite)


def written(folder: str) -> dict[str, int]:
    """Records and segments that finished writes have put into a folder."""
    total = {"records": 0, "segments": 0}
    for n in os.listdir(folder):
        if n.endswith(".written"):
            with open(os.path.join(folder, n)) as f:
                for k, v in json.load(f).items():
                    total[k] += v
    return total


def load(spark, folder: str, strict: bool = False):
    """All records of a folder in time order, ties in the order of file, batch and place."""
    from pyspark.sql import functions as F

    spark.dataSource.register(SegmentSource)
    rows = spark.read.format("segments").option("mode", "FAILFAST" if strict else "PERMISSIVE").load(folder)
    return rows.orderBy("timestamp_us", "file", "sequence", "pos").withColumn("key", F.col("key_hash"))
