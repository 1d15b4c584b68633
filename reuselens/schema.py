"""Schemas, feature names and defaults."""

from pyspark.sql import types as T

#: One access: the key's 64-bit hash (or the key itself), microseconds, bytes, and whether the object was resident.
ACCESS = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("timestamp_us", T.LongType()), T.StructField("size_bytes", T.LongType()),
    T.StructField("hit", T.BooleanType()), T.StructField("ordinal", T.LongType()),
])
#: One record of a segment file, with its place.
SEGMENT_RECORD = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("pos", T.LongType()),
    T.StructField("key_hash", T.LongType()), T.StructField("timestamp_us", T.LongType()), T.StructField("size_bytes", T.LongType()), T.StructField("hit", T.BooleanType()),
])
MODEL_META = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("format", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("sha256", T.StringType()),
    T.StructField("created_unix", T.LongType()), T.StructField("feature_count", T.LongType()), T.StructField("boundary_seconds", T.LongType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
])

HISTORY = 8
FEATURES = ["size_bytes", "recency_ms", "age_ms", "accesses", "frequency", "reuse_rate", *(f"delta_{k}" for k in range(HISTORY))]
UINT32 = 4_294_967_295
FREQUENCY_MAX = 3
HOLDOUT, MIN_CLASS_RATE = 0.2, 0.02
#: Recency is drawn up to this many boundaries.
RECENCY_BOUNDARIES = 4
MODEL_FORMAT = "lightgbm-text"
