"""What the training-data operators share: table access, shared-storage staging, the training split."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reuselens-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    The folder is removed when the driver's Python ends, not before: the frame that is returned reads it lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reuselens/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended first; the folder is then left to its owner
        pass


#: Bits of a bitmap, a power of two: at most BITS / 64 rows of two numbers are broadcast, whatever the number of ids.
BITS = 1 << 24


def maybe_in(df: DataFrame, column: str, ids: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows of ``df`` whose id may be in ``ids`` (one column of that name): all that are, and some that are not.

    wanted off: the other rows, whose id is certainly not in ``ids``, rows without id among them. The ids set bits of a bitmap
    of bounded size, one for each id's hash, which is broadcast; the more ids there are, the more other rows pass.
    """
    word, bit, row = fresh(df, "word", "bit", "bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    bits = (
        ids.where(F.col(column).isNotNull()).select(place(F.col(column)).alias("p"))
        .select(F.shiftright("p", 6).alias(word), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b")).groupBy(word).agg(F.bit_or("b").alias(row))
    )
    names = [F.col(f"`{c}`") for c in df.columns]
    at = place(F.col(f"`{column}`"))
    out = df.withColumn(word, F.when(F.col(f"`{column}`").isNotNull(), F.shiftright(at, 6))).withColumn(bit, at.bitwiseAND(63).cast("int"))
    out = out.join(F.broadcast(bits), word, "left")
    is_set = F.coalesce(F.getbit(F.col(row), F.col(bit)) == 1, F.lit(False))
    return out.where(is_set if wanted else ~is_set).select(*names)


#: A key with more rows than HOT, and than 1 / MOST_HOT of all rows, is joined by a broadcast of its one row: at most MOST_HOT rows.
HOT, MOST_HOT = 1_000, 5_000


def keyed_join(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key, and in column ``rows`` how many rows of ``left`` have it.

    The rows of hot keys stay where they are; only the others are shuffled, so no task gets more of one key than HOT or
    1 / MOST_HOT of all rows.
    """
    size = right.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("all"), F.coalesce(F.max(rows), F.lit(0)).alias("most")).first()
    hot = max(HOT, size["all"] // MOST_HOT)
    if size["most"] <= hot:
        return left.join(right.drop(rows), key)
    heavy = right.where(F.col(rows) > hot).drop(rows)
    light = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(right.where(F.col(rows) <= hot).drop(rows), key)
    return light.union(left.join(F.broadcast(heavy), key).select(*light.columns))


def held_out(doc_id: Column | str) -> Column:
    """Whether labels of the row are kept from training: crc32 of the id as text, modulo 3, is 1 (null id: not)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Labelled rows that a classifier is fitted on, at most. They are the rows with the least hash of their id.
TRAIN_ROWS = 12_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled rows outside the held-out third.

    The sample is by hash of the id, so it does not depend on order or partitioning. Rows without id or label are no
    training rows; of several labels for one id the largest holds; of several texts for one id the one with the least hash,
    so that the bound is one of rows, whatever the ids.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    # at most ``bound`` pairs of an id and a label, hence the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k, own = 0, name
        while own.lower() in have:
            k += 1
            own = f"{name}_{k}"
        have.add(own.lower())
        out.append(own)
    return out
