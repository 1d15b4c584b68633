"""Goldens and properties of the trace engine."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from reuselens.functions import hashing as H
from reuselens.functions import model as M
from reuselens.functions import scalars as S
from reuselens.operators import optimum, replay, ring, simulator, stats, trace
from reuselens.schema import ACCESS, FEATURES
from reuselens.sources import registry, segments

S1 = 1_000_000


def accesses(spark, rows):
    return spark.createDataFrame([(k, t, s, h, i) for i, (k, t, s, h) in enumerate(rows)], ACCESS)


def at(microseconds):
    return lambda span: F.least(F.lit(microseconds), span - 1)


def test_hash_is_the_same_in_spark_and_python(spark):
    keys = ["", "a", "key-1", "schlüssel", "x" * 100]
    got = H.with_hash(spark.createDataFrame([(k,) for k in keys], "key string")).select("key", H.unsigned(F.col("key_hash")).alias("h")).collect()
    assert {r["key"]: int(r["h"]) for r in got} == {k: H.hash_key(k) for k in keys}


def test_hash_leaves_the_session_as_it_was(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    H.with_hash(spark.createDataFrame([("a",)], "key string"))
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_shards_are_even_and_powers_of_two(spark):
    keys = H.with_hash(spark.range(64_000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key")))
    counts = [r["count"] for r in keys.groupBy(H.shard_of(F.col("key_hash"), 64)).count().collect()]
    assert len(counts) == 64 and all(700 <= c <= 1300 for c in counts)
    assert [H.pow2(n) for n in (100, 1, 0, -3)] == [128, 1, 256, 256]


def test_sampling_keeps_keys_whole(spark):
    rows = spark.range(4000).select((F.col("id") * (1 << 32)).alias("h"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    kept = rows.where(H.sampled(F.col("h"), 8)).groupBy("h").count().collect()
    assert {r["count"] for r in kept} == {3} and len(kept) == 500


def test_replay_of_one_object(spark):
    t = accesses(spark, [(7, 0, 100, False), (7, 2 * S1, 100, True), (7, 5 * S1, 100, True), (7, 9 * S1, 100, True)])
    rows = replay.samples(t, S1, at(0), 4 * S1).orderBy("ordinal").collect()
    assert [r["kept"] for r in rows] == [True, True, True, False]
    assert [r["accesses"] for r in rows] == [1, 2, 3, 4] and [r["frequency"] for r in rows] == [1, 2, 3, 3]
    assert [r["delta_0"] for r in rows[:3]] == [0, 2000, 3000] and rows[2]["delta_1"] == 2000


def test_a_miss_begins_a_segment(spark):
    t = accesses(spark, [(7, 0, 64, False), (7, S1, 64, True), (7, 4 * S1, 64, False), (7, 6 * S1, 64, True), (7, 9 * S1, 64, True)])
    rows = replay.samples(t, S1, at(0), 4 * S1).orderBy("ordinal").collect()
    assert [r["segment"] for r in rows] == [1, 1, 2, 2, 2] and [r["accesses"] for r in rows[:4]] == [1, 2, 1, 2]
    assert rows[2]["delta_0"] == 0 and rows[3]["delta_0"] == 2000 and 2000 <= rows[3]["age_ms"] < 5000


def test_labels_and_censoring(spark):
    t = accesses(spark, [(1, 0, 111, False), (1, 10 * S1, 111, True), (2, 0, 222, False), (2, S1 // 10, 222, True)])
    rows = replay.samples(t, S1, at(0), 4 * S1).collect()
    assert [r["y"] for r in rows if r["key"] == 1 and r["kept"]] == [1]
    assert sorted(r["y"] for r in rows if r["key"] == 2 and r["kept"]) == [0, 1]
    short = replay.samples(accesses(spark, [(7, 0, 8, False), (7, 1000, 8, True)]), S1, at(0), S1).collect()
    assert sorted((r["kept"], r["y"]) for r in short) == [(False, 1), (True, 0)]


def test_same_microsecond_and_quantiles(spark):
    t = accesses(spark, [(7, 0, 40, False), (7, 1000, 40, True), (7, 1000, 40, True), (7, 4 * S1, 40, True)])
    rows = replay.samples(t, S1, None, 4 * S1).orderBy("ordinal").collect()
    assert rows[1]["recency_ms"] == 0 and rows[1]["y"] == 0
    q = replay.reuse_quantiles(accesses(spark, [(7, 0, 1, True), (7, S1, 1, True), (7, 3 * S1, 1, True), (7, 6 * S1, 1, True)]), [0.5, 1.0]).collect()
    assert [r["gap_us"] for r in q] == [2 * S1, 3 * S1]
    assert [r["gap_us"] for r in replay.reuse_quantiles(accesses(spark, []), [0.5]).collect()] == [0]


def test_empty_trace(spark):
    t = accesses(spark, [])
    assert replay.samples(t, S1).count() == 0
    assert trace.duration(t).first().asDict() == {"records": 0, "duration_us": 0}
    assert trace.with_positions(t).count() == 0


def test_reuse_rate(spark):
    rows = replay.samples(accesses(spark, [(7, 0, 100, False), (7, 8 * S1, 100, True)]), S1, at(3 * S1), 4 * S1).where("kept").collect()
    for r in rows:
        assert r["reuse_rate"] == pytest.approx(r["accesses"] / (r["age_ms"] / 1e3 + 1), rel=1e-3)


TEXTBOOK = [7, 0, 1, 2, 0, 3, 0, 4, 2, 3, 0, 3, 2, 1, 2, 0, 1, 7, 0, 1]


def requests(spark, keys):
    return spark.createDataFrame([(i, k, i * S1, 1) for i, k in enumerate(keys, 1)], "pos bigint, key bigint, timestamp_us bigint, size_bytes bigint")


@pytest.mark.parametrize(("capacity", "hits"), [(3, 11), (100, 14), (1, 0), (0, 0)])
def test_optimum_of_the_textbook(spark, capacity, hits):
    assert optimum.optimum(requests(spark, TEXTBOOK), capacity).first()["hits"] == hits


def events_table(tmp_path, n):
    """A folder with n events in time order, and their users."""
    import datetime
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    draw = random.Random(7)
    users = [min(int(draw.paretovariate(0.6)), 400) for _ in range(n)]
    start = datetime.datetime(2024, 1, 1)
    ts = pa.array([start + datetime.timedelta(seconds=i) for i in range(n)], pa.timestamp("us"))
    pq.write_table(pa.table({"event_id": pa.array(range(n), pa.int64()), "ts": ts, "user_id": pa.array(users, pa.int64()), "event_type": ["click"] * n, "value": [1.0] * n}), tmp_path / "events.parquet")
    return users


def test_min_hits_takes_the_whole_trace(spark, tmp_path):
    from reuselens.plans import catalog

    users = events_table(tmp_path, 1500)
    hits, resident = 0, set()
    for i, k in enumerate(users):  # the furthest next use by search
        if k in resident:
            hits += 1
        elif len(resident) >= catalog.MIN_CAPACITY:
            after = {x: next((j for j in range(i + 1, len(users)) if users[j] == x), len(users) + i) for x in resident}
            resident.remove(max(after, key=after.get))
        resident.add(k)
    assert catalog.QUERIES["min_hits"](spark, str(tmp_path)).first().asDict() == {"requests": 1500, "hits": hits}


def test_sim_lfu_takes_the_whole_trace(spark, tmp_path):
    from reuselens.plans import catalog

    users = events_table(tmp_path, 1500)
    counts, want = {}, []
    for k in users:  # the least count goes, of equal ones the least key
        want.append(k in counts)
        if k not in counts and len(counts) >= catalog.MIN_CAPACITY:
            del counts[min(counts, key=lambda x: (counts[x], x))]
        counts[k] = counts.get(k, 0) + 1
    got = catalog.QUERIES["sim_lfu"](spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["key"] for r in got] == users and [r["hit"] for r in got] == want and any(want[1000:])


def test_optimum_is_no_worse_than_lru_and_monotone(spark):
    keys = [r["rank"] for r in S.zipf_requests(spark, 4000, 500, 1.2).orderBy("pos").collect()]
    r = requests(spark, keys)
    d = optimum.stack_distances(r)
    best = [optimum.optimum(r, c).first()["hits"] for c in (10, 50, 200)]
    lru = [x["hits"] for x in optimum.miss_ratio_curve(d, [10, 50, 200]).orderBy("capacity").collect()]
    assert best == sorted(best) and all(b >= x for b, x in zip(best, lru, strict=True))
    sim = simulator.totals(simulator.simulate(r, "lru", 50)).first()["hits"]
    assert sim == lru[1]


@pytest.mark.parametrize("name", simulator.POLICIES)
def test_policies_keep_the_accounts(spark, name):
    r = S.zipf_requests(spark, 8000, 2000, 1.1).withColumnRenamed("key", "name").withColumn("key", F.col("rank")).withColumn("timestamp_us", F.col("pos") * 1000).withColumn("size_bytes", 64 + F.col("rank") % 512)
    model = M.Model((M.Tree((3,), (2.5,), (-1,), (-2,), (1.0, -1.0)),), len(FEATURES), "binary")
    t = simulator.totals(simulator.simulate(r, name, 64 << 10, shards=4, sample=8, model=model)).first()
    assert t["hits"] + t["misses"] == 8000 and t["evictions"] > 0 and t["max_used_bytes"] <= (64 << 10) // 4 and t["hits"] / 8000 >= 0.2


def shard(capacity, name="lru", **k):
    return simulator.Shard(capacity, simulator.policy(name, capacity, 1 << 30), **k)


def test_shard_rules():
    s = shard(10_000)
    for _ in range(100):
        s.insert(1, 1000, 0)
    assert len(s.entries) == 1 and s.used == 1000
    s = shard(1000)
    s.insert(1, 500, 0)
    assert s.insert(2, 2000, 0) == (False, []) and 1 in s.entries and s.count["rejections"] == 1
    s = shard(300)
    for k in (1, 2, 3):
        s.insert(k, 100, k)
    s.get(1, 4), s.get(2, 5)
    assert s.insert(4, 100, 6) == (True, [3])


def test_deadlines_are_looked_at_on_reading():
    s = shard(1000, default_ttl_us=3000)
    s.insert(1, 10, 0)
    assert s.get(1, 2999) and not s.get(1, 3000) and s.count["expirations"] == 1 and s.used == 0
    s = shard(1000)
    s.insert(1, 10, 0)
    assert s.get(1, 10**15)


def test_learned_policy_uses_the_model():
    chain = M.Model((M.Tree((3,), (1.5,), (-1,), (-2,), (1.0, 0.0)),), len(FEATURES))
    for model, victim in ((None, 1), (chain, 4)):
        s = simulator.Shard(400, simulator.policy("learned", 400, 1 << 30, model))
        for k in (1, 2, 3, 4):
            s.insert(k, 100, k)
        for now, k in enumerate((1, 1, 2, 2, 3), 10):
            s.get(k, now)
        if model is None:
            s.entries[4].last_access = 99
        assert s.insert(9, 100, 100)[1] == [victim]


def test_a_replaced_key_loses_its_place_in_the_main_queue():
    q = simulator.ThreeQueues(1000)
    entries = {k: simulator.Entry(k, 100, 0, 0) for k in (1, 2)}
    for k in (1, 2):
        q.remember(k)
        q.on_admit(entries[k])
    q.on_remove(entries[1])
    q.remember(1)
    q.on_admit(entries[1])
    assert list(q.main) == [2, 1] and q.victim(entries, 0) == 2


class PlainThreeQueues:
    """The published algorithm on lists of [key, uses]; every departure of the small queue is kept, and searched."""

    def __init__(self, capacity):
        self.capacity, self.small, self.main, self.departed, self.sizes = capacity, [], [], [], {}

    def used(self):
        return sum(self.sizes.values())

    def drop(self, key):
        self.small = [x for x in self.small if x[0] != key]
        self.main = [x for x in self.main if x[0] != key]
        self.sizes.pop(key, None)

    def evict(self):
        while True:
            waiting = sum(self.sizes[k] for k, _ in self.small)
            if self.small and (waiting >= max(1, self.capacity // 10) or not self.main):
                key, uses = self.small.pop(0)
                if uses:
                    self.main.append([key, 0])
                    continue
                self.departed.append(key)
            else:
                key, uses = self.main.pop(0)
                if uses:
                    self.main.append([key, uses - 1])
                    continue
            del self.sizes[key]
            return

    def insert(self, key, size):
        if size > self.capacity:
            return
        self.drop(key)
        while self.used() + size > self.capacity:
            self.evict()
        recent = self.departed[-max(16, self.capacity // 1024) :]
        back = key in recent
        # a departure that was answered by a return counts in the memory's length only
        self.departed = [None if k == key else k for k in self.departed]
        (self.main if back else self.small).append([key, 0])
        self.sizes[key] = size

    def get(self, key, size):
        for x in self.small + self.main:
            if x[0] == key:
                x[1] = min(3, x[1] + 1)
                return True
        self.insert(key, size)
        return False


@pytest.mark.parametrize("seed", range(6))
def test_three_queues_against_the_plain_algorithm(seed):
    r = random.Random(seed)
    capacity = r.choice([60, 200, 1000])
    plain, shard = PlainThreeQueues(capacity), simulator.Shard(capacity, simulator.policy("s3fifo", capacity))
    for now in range(4000):
        key = min(int(r.paretovariate(0.7)), 90) if r.random() < 0.8 else r.randint(100, 400)
        size = 1 + key * 7 % 19
        what = r.random()
        if what < 0.03:
            assert shard.delete(key) == (key in plain.sizes)
            plain.drop(key)
        elif what < 0.08:
            shard.insert(key, size, now, after_miss=False)
            plain.insert(key, size)
        else:
            hit = shard.get(key, now)
            if not hit:
                shard.insert(key, size, now)
            assert hit == plain.get(key, size), now
        assert shard.used == plain.used() and set(shard.entries) == set(plain.sizes)


def test_scan_resistance():
    """Of a working set in use, more outlives a scan under S3-FIFO than under LRU."""
    left = {}
    for name in ("lru", "s3fifo"):
        shard = simulator.Shard(1 << 20, simulator.policy(name, 1 << 20, 1 << 30))
        for now, key in enumerate([k for _ in range(5) for k in range(800)] + list(range(10_000, 14_000))):
            if not shard.get(key, now):
                shard.insert(key, 512, now)
        left[name] = sum(k in shard.entries for k in range(800))
    assert left["s3fifo"] > left["lru"]


def test_model_holder():
    holder = simulator.ModelHolder()
    assert (holder.model, holder.version, holder.boundary_us) == (None, "", 0)
    chain = M.Model((M.Tree((3,), (1.5,), (-1,), (-2,), (1.0, 0.0)),), len(FEATURES))
    shard = simulator.Shard(400, simulator.policy("learned", 400, 1 << 30, holder))
    for k in (1, 2, 3, 4):
        shard.insert(k, 100, k)
    for now, k in enumerate((1, 1, 2, 2, 3), 10):
        shard.get(k, now)
    shard.entries[4].last_access = 99
    for model, boundary in ((M.Model((), 2), 60), (chain, 0)):
        with pytest.raises(ValueError, match="model v0"):
            holder.store(model, "v0", boundary)
    assert holder.version == "" and shard.insert(8, 100, 100)[1] == [1]  # recency, as nothing was taken
    shard.entries[8].last_access, shard.entries[8].accesses = 100, 5
    holder.store(chain, "v1", 60)
    assert (holder.version, holder.boundary_us) == ("v1", 60) and shard.insert(9, 100, 100)[1] == [4]


def test_routing_without_nodes(spark):
    keys = H.with_hash(spark.createDataFrame([("a",), ("",), (None,)], "key string"))
    got = ring.routed(keys, ring.vnodes(spark, [])).collect()
    assert sorted((x["key"] or "", x["node"], x["status"]) for x in got) == [("", None, 400), ("", None, 400), ("a", None, 503)]


def test_settings(monkeypatch):
    said = []
    monkeypatch.delenv("LENS_TEST", raising=False)
    assert S.setting("LENS_TEST", 3, int) == 3
    monkeypatch.setenv("LENS_TEST", "5")
    assert S.setting("LENS_TEST", 3, int) == 5
    monkeypatch.setenv("LENS_TEST", "x")
    assert S.setting("LENS_TEST", 3, int, warn=said.append) == 3 and "LENS_TEST" in said[0]
    with pytest.raises(ValueError):
        S.setting("LENS_TEST", 3, int, strict=True)


def test_sources_and_clamped_ratios(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.0), (1, 3.0, 2.0), (2, 0.0, -1.0), (9, 1.0, 4.0)], "c int, a double, b double")
    got = rows.select(S.source_name(F.col("c")).alias("s"), S.clamped_ratio(F.col("a"), F.col("b"), 0.5).alias("r")).collect()
    assert [tuple(x) for x in got] == [("unknown", 2.0), ("cache", 1.5), ("origin", 0.0), ("unknown", 0.25)]


def test_ring_properties(spark):
    keys = H.with_hash(spark.range(20_000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key")))
    names = [f"n{k}" for k in range(4)]
    before, after = ring.vnodes(spark, names), ring.vnodes(spark, [*names, "n4", "n4"])
    placed = ring.lookup(ring.lookup(keys, before, out="a"), after, out="b").cache()
    moved = placed.where("a <> b")
    assert 0.1 <= moved.count() / 20_000 <= 0.3 and moved.where("b <> 'n4'").count() == 0
    assert ring.lookup_join(placed, before, out="c").where("a <> c").count() == 0
    r = ring.BoundedRing(names)
    for _ in range(400):
        r.pick("hot")
    assert max(r.load.values()) <= 100 * 1.25 + 2
    one = ring.BoundedRing(["only"])
    assert one.pick("x") == "only"
    with pytest.raises(ValueError):
        ring.BoundedRing([]).pick("x")


TINY = M.Model((M.Tree((0, 1), (10.0, 5.0), (1, -1), (-3, -2), (0.5, 0.25, -0.5)), M.Tree((1,), (2.0,), (-1,), (-2,), (0.1, -0.1)), M.Tree((), (), (), (), (0.05,))), 2, "binary sigmoid:1")


@pytest.mark.parametrize(("x", "raw"), [((1, 1), 0.65), ((1, 9), 0.20), ((20, 1), -0.35), ((20, 9), -0.55), ((10, 5), 0.45), ((10, 2), 0.65)])
def test_tree_sums(spark, x, raw):
    model = M.parse(M.dump(TINY))
    assert model == TINY
    got = spark.createDataFrame([tuple(map(float, x))], "a double, b double").select(model.raw_column([F.col("a"), F.col("b")]).alias("r"), model.score_column([F.col("a"), F.col("b")]).alias("s")).first()
    assert model.raw(list(x)) == pytest.approx(raw) and got["r"] == pytest.approx(raw) and got["s"] == pytest.approx(model.score(list(x)))


@pytest.mark.parametrize(("old", "new"), [
    ("max_feature_idx=1", ""), ("num_class=1", "num_class=2"), ("num_cat=0", "num_cat=1"), ("is_linear=0", "is_linear=1"), ("decision_type=0 0", "decision_type=1 0"), ("decision_type=0 0", "decision_type=4 0"),
    ("split_feature=0 1", "split_feature=0 7"), ("left_child=1 -1", "left_child=1 -9"), ("left_child=1 -1", "left_child=-1 -1"), ("threshold=10.0 5.0", "threshold=10.0"), ("leaf_value=0.5 0.25 -0.5", "leaf_value=0.5 x -0.5"),
])
def test_malformed_models(old, new):
    text = M.dump(TINY)
    assert old in text
    with pytest.raises(M.Malformed):
        M.parse(text.replace(old, new, 1))


def test_segment_files(spark, tmp_path):
    good = segments.frame(segments.encode_batch("n/0", 1, [(1, 100, 64, False), (-2, 200, 128, True)]))
    (tmp_path / "a.trace").write_bytes(good + good[: len(good) // 2])
    (tmp_path / "b.trace").write_bytes(segments.frame(segments.encode_batch("n/1", 0, [(3, 50, 32, True)])))
    (tmp_path / "c.partial").write_bytes(good)
    rows = segments.load(spark, str(tmp_path)).collect()
    assert [(r["key_hash"], r["timestamp_us"], r["size_bytes"], r["hit"]) for r in rows] == [(3, 50, 32, True), (1, 100, 64, False), (-2, 200, 128, True)]
    with pytest.raises(segments.Torn):
        list(segments.batches((tmp_path / "a.trace").read_bytes(), strict=True))
    with pytest.raises(segments.Corrupt):
        list(segments.frames(b"\xff" * 11, strict=True))
    with pytest.raises(FileNotFoundError, match="still open"):
        os.remove(tmp_path / "a.trace"), os.remove(tmp_path / "b.trace")
        segments.segments(str(tmp_path))


def test_segments_written_by_spark(spark, tmp_path):
    spark.dataSource.register(segments.SegmentSource)
    df = spark.range(2000).select(F.col("id").alias("key_hash"), (F.col("id") * 10).alias("timestamp_us"), F.lit(100).cast("bigint").alias("size_bytes"), (F.col("id") % 2 == 0).alias("hit")).repartition(2)
    df.write.format("segments").option("batch", 64).option("segmentBytes", 2048).mode("append").save(str(tmp_path))
    assert len(segments.segments(str(tmp_path))) > 2 and not list(tmp_path.glob("*.partial"))
    back = spark.read.format("segments").load(str(tmp_path))
    assert back.count() == 2000 and back.select("key_hash").distinct().count() == 2000


def test_segments_rotate_by_age_and_say_what_was_written(spark, tmp_path):
    spark.dataSource.register(segments.SegmentSource)
    rows = spark.range(500).select(F.col("id").alias("key_hash"), F.col("id").alias("timestamp_us"), F.lit(7).alias("size_bytes"), F.lit(True).alias("hit")).coalesce(1)
    for age, files in ((0, 5), (60_000_000, 1)):
        at = str(tmp_path / f"age{age}")
        rows.write.format("segments").option("batch", 100).option("maxAgeUs", age).mode("append").save(at)
        assert len(segments.segments(at)) == files and segments.written(at) == {"records": 500, "segments": files}
        assert segments.load(spark, at, strict=True).count() == 500


def test_captured_stream(spark, tmp_path):
    from reuselens.streaming import stateful

    rows = spark.range(300).select(F.col("id").alias("key_hash"), F.col("id").alias("timestamp_us"), F.lit(7).cast("bigint").alias("size_bytes"), F.lit(True).alias("hit"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    at = str(tmp_path / "segments")
    for k in range(2):  # the second run, without the first one's checkpoint, replaces its batches
        stateful.capture(stateful.file_stream(spark, str(tmp_path / "in"), rows.schema), at, str(tmp_path / f"at{k}")).awaitTermination()
        assert sorted(x["key_hash"] for x in segments.load(spark, at, strict=True).collect()) == list(range(300))
        assert segments.written(at)["records"] == 300


def test_single_flight_of_a_hot_key(spark):
    """Against a plain fold; one key, null keys, ties, over many batches."""
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2, None]), r.randint(0, 60_000), k) for k in range(30_000)]
    df = spark.createDataFrame(rows, "key bigint, timestamp_us bigint, ordinal bigint").repartition(7)
    until, want = {}, {}
    for key, t, k in sorted(rows, key=lambda x: x[1:]):
        want[k] = t >= until.get(key, -1)
        if want[k]:
            until[key] = t + 50
    assert {x["ordinal"]: x["fetched"] for x in stats.single_flight(df, 50).collect()} == want


def test_quantiles_and_medians_are_elements(spark):
    r = random.Random(5)
    rows = [(g, r.choice([r.randint(-50, 50), r.randint(-(10**9), 10**9)])) for g in (1, 2, 3) for _ in range(g * 137)] + [(4, 9), (5, None)]
    df = spark.createDataFrame(rows, "g int, v bigint")
    got = {(x["g"], x["quantile"]): x["value"] for x in stats.lower_quantiles(df, "v", [0.0, 0.5, 0.99, 1.0], "g").collect()}
    medians = {x["g"]: x["m"] for x in df.groupBy("g").agg(stats.lower_median("v").alias("m")).collect()}
    for g in (1, 2, 3, 4):
        v = sorted(x for k, x in rows if k == g)
        assert all(got[g, q] == v[int(q * (len(v) - 1))] for q in (0.0, 0.5, 0.99, 1.0)) and medians[g] == v[(len(v) - 1) // 2]
    assert len(got) == 16 and stats.lower_quantiles(df.limit(0), "v", [0.5], "g").count() == 0


def test_one_of_many_publishers_wins(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    r = registry.Registry(str(tmp_path))

    def publish(k):
        body = b"model %d" % k
        try:
            return r.publish(registry.describe(body, "v1", 60), body), body
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(publish, range(40)) if x]
    assert len(won) == 1 and r.get("v1")[1] == won[0][1] and sorted(os.listdir(tmp_path)) == ["v1.meta", "v1.model"]
    body = b"after a broken attempt"
    (tmp_path / "v2.model").write_bytes(body)
    assert r.publish(registry.describe(body, "v2", 60), body) == "v2"
    for name in ("a.b", ".a", "a/b", "a\\b", ""):
        assert "bare name" in registry.problem(registry.describe(body, name, 60), body)


def test_registry(tmp_path):
    r = registry.Registry(str(tmp_path))
    body = b"tree" * 100
    for v in ("20240101T000000000Z", "20240102T000000000Z"):
        r.publish(registry.describe(body, v, 60), body)
    assert r.latest() == "20240102T000000000Z" and r.get()[1] == body
    with pytest.raises(FileExistsError):
        r.publish(registry.describe(body, "20240101T000000000Z", 60), body)
    good = registry.describe(body, "v3", 60)
    for change in ({"version": "../x"}, {"version": ""}, {"version": ".x"}, {"format": "onnx"}, {"feature_count": 3}, {"boundary_seconds": 0}, {"size_bytes": 1}, {"sha256": "0"}):
        with pytest.raises(registry.Refused):
            r.publish(good | change, body)
    (tmp_path / "zzz.model").write_bytes(b"orphan")
    assert r.latest() == "20240102T000000000Z"
    assert registry.assembled(registry.messages(good, body)) == (good, body)
    for bad in ([(None, b"x")], [(good, None), (good, None)], [(good, None)], [(good, None), (None, body + b"x")], [(good, None), (None, body[::-1])]):
        with pytest.raises(registry.Refused):
            registry.assembled(bad)


def test_version_names_sort_as_times():
    assert registry.version_for(0.0) == "19700101T000000000Z" and registry.version_for(1.5) < registry.version_for(2)


@pytest.mark.parametrize(("text", "ns"), [("1h30m", 5400 * 10**9), ("1.5s", 1_500_000_000), ("+2us", 2000), ("-1ms", -1_000_000), ("1µs", 1000), ("1μs", 1000), ("0", 0), (".5s", 500_000_000), ("1.s", 10**9), ("1.9999999999ns", 1), ("-9223372036854775808ns", -(2**63)), ("9223372036854775807ns", 2**63 - 1)])
def test_durations(text, ns):
    assert S.duration_ns(text) == ns


@pytest.mark.parametrize("text", ["", "1", "s", ".s", "1d", "1 s", "1s ", "--1s", "1e3s", "9999999999h", "1h30", "9223372036854775808ns"])
def test_refused_durations(text):
    with pytest.raises(ValueError):
        S.duration_ns(text)


def test_sizes_and_limits():
    assert [S.size_bytes(t) for t in ("1", "1kb", "1KiB", "2 MB", "1g")] == [1, 1024, 1024, 2 << 20, 1 << 30]
    for t in ("", "0", "-1", "1.5mb", "mb", "1 x"):
        with pytest.raises(ValueError):
            S.size_bytes(t)
    assert S.ttl_seconds("90s") == 90
    for t in ("100ms", "soon", "0s", "2000000h"):
        with pytest.raises(ValueError):
            S.ttl_seconds(t)
    assert S.boundary_seconds(30 * S1) == 30
    for b in (500_000, 1_500_000, 0):
        with pytest.raises(ValueError):
            S.boundary_seconds(b)


def test_human_bytes_round_exactly(spark):
    r, units = random.Random(7), ("B", "KiB", "MiB", "GiB", "TiB", "PiB")
    numbers = [0, 1, -5, 1023, 1 << 20, (1 << 30) - 1, 1280, 1792, (1 << 40) - 1, 5_010_254_585_449_677, (1 << 63) - 1, *(r.randrange(1 << e, 2 << e) for e in range(10, 63))]
    numbers += [((r.randrange(1, 4000) * 20 + r.randrange(1, 20, 2)) << 10 * k) // 20 + d for k in range(1, 6) for _ in range(100) for d in (-1, 0, 1)]  # at and beside half tenths
    want = []
    for n in numbers:
        k = max((k for k in range(6) if n >= 1 << 10 * k), default=0)
        want.append(f"{n / (1 << 10 * k):.1f} {units[k]}" if k else f"{n} B")
    rows = spark.createDataFrame([*enumerate(numbers), (len(numbers), None)], "i int, n bigint")
    assert [x["h"] for x in rows.orderBy("i").select(S.human_bytes(F.col("n")).alias("h")).collect()] == [*want, None]


def test_human_bytes_takes_large_keys(spark, tmp_path):
    """Against its SQL, beyond 1 TiB and 2^51 too."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from reuselens.plans import catalog

    r = random.Random(7)
    keys = [0, 5, 32, 1000, 160_010, 1_199_999, *(r.randrange(6_000_000, 429_496_729) for _ in range(3000))]
    sizes = [None if k == 1000 else r.randint(1, 50) for k in keys]
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_size": pa.array(sizes, pa.int32())}), tmp_path / "part.parquet")
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet'")
    got = catalog.QUERIES["human_bytes"](spark, str(tmp_path)).collect()
    assert {tuple(x) for x in got} == set(engine.execute(catalog.SQL["human_bytes"]).fetchall()) and len(got) == len(keys)


def test_stats(spark):
    columns = "node string, seq bigint, " + ", ".join(f"{c} bigint" for c in (*stats.COUNTERS, *stats.GAUGES)) + ", policy string, model_version string"
    row = lambda node, seq, hits, ns, n, v="v1": (node, seq, hits, 1, 10, 10, 0, 0, ns, n, 1, 1, 1, "lrb", v)
    m = stats.merge(spark.createDataFrame([row("a", 1, 1, 20_000, 2), row("b", 1, 1, 1_000_000, 10_000, "v2")], columns)).first()
    assert (m["evict_ns_sum"], m["evict_samples"], m["evict_ns_mean"], m["model_version"], m["policy"]) == (1_020_000, 10_002, 101, "mixed", "lrb")
    d = stats.window_delta(spark.createDataFrame([row("a", 1, 100, 0, 0), row("a", 2, 10, 0, 0)], columns))
    assert d.first()["restarted"]
    with pytest.raises(ValueError):
        stats.require_no_restart(d)


def test_stats_delta_takes_every_supplier(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from reuselens.plans import catalog

    pq.write_table(pa.table({"s_suppkey": pa.array(range(1, 61), pa.int64())}), tmp_path / "supplier.parquet")
    got = {r["seq"]: r for r in catalog.QUERIES["stats_delta"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(8, 61))  # all but the first of each of the seven series
    for k, r in got.items():
        rejections, samples = k % 5 - (k - 7) % 5, k % 11 - (k - 7) % 11
        fell = min(rejections, samples) < 0
        assert (r["node"], r["hits"], r["rejections"], r["evict_ns_sum"], r["evict_samples"], r["restarted"]) == (str(k % 7), 91, rejections, 7000, samples, fell)
        assert r["objects"] == 2 * k and r["evict_ns_mean"] == (0 if fell or not samples else 7000 // samples)
    assert {r["restarted"] for r in got.values()} == {True, False}


def test_latency_split(spark):
    got = stats.latency_split(spark.createDataFrame([(100, True), (200, True), (300, True), (2000, False)], "ns bigint, from_cache boolean")).first()
    assert (got["mean_ns"], got["mean_hit_ns"], got["mean_miss_ns"]) == (650, 200, 2000)
    assert stats.latency_split(spark.createDataFrame([], "ns bigint, from_cache boolean")).first()["mean_ns"] == 0


def test_training_of_two_populations(spark):
    from reuselens.operators import training

    hot = [(k, t * S1 // 2 + k, 1024, t > 0) for k in range(10) for t in range(120)]
    cold = [(100 + k, t * 4 * S1 + 1000 * k, 1024, t > 0) for k in range(80) for t in range(15)]
    fitted = training.train(accesses(spark, sorted(hot + cold, key=lambda r: r[1])), S1, trees=8, depth=4)
    assert 0.1 < fitted.positive_rate < 0.9 and fitted.auc > 0.9
    assert json.loads(fitted.summary())["trees"] == len(M.parse(M.dump(fitted.model)).trees)


def test_training_stops_at_the_least_loss(spark, monkeypatch):
    from reuselens.operators import training
    from reuselens.plans import catalog

    assert training.best_round([5, 4, 3, 4, 4, 2], 2) == (3, True) and training.best_round([5, 4, 3, 4, 4, 2], 3) == (6, False)
    hot = [(k, t * S1 // 2 + k, 1024, t > 0) for k in range(10) for t in range(120)]
    cold = [(100 + k, t * 4 * S1 + 1000 * k, 1024, t > 0) for k in range(80) for t in range(15)]
    trace_of = accesses(spark, sorted(hot + cold, key=lambda r: r[1]))
    fitted = training.train(trace_of, S1, trees=12, depth=3, patience=3)
    assert 1 <= len(fitted.model.trees) <= 12 and fitted.auc > 0.9
    asked = {}
    monkeypatch.setattr(training, "fit", lambda rows, **options: asked.update(options) or fitted)
    monkeypatch.setattr(catalog, "_samples", lambda *_: None)
    catalog.QUERIES["gbt_fit_auc"](spark, "")
    assert asked == {"trees": 300, "depth": 8, "patience": 25}


def test_degenerate_labels(spark):
    from reuselens.operators import training

    with pytest.raises(training.DegenerateLabels):
        training.train(accesses(spark, [(1, t * 1000, 8, t > 0) for t in range(3000)]), S1)


def test_streams(spark, tmp_path):
    from reuselens.streaming import stateful

    r = registry.Registry(str(tmp_path / "models"))
    body = b"body"
    for v in ("a1", "a2"):
        r.publish(registry.describe(body, v, 60), body)
    loaded = []
    install = stateful.installer(lambda m: None if m["boundary_seconds"] == 60 else "boundary", r.get, lambda b, m: loaded.append(m["version"]))
    events = stateful.model_events(spark, str(tmp_path / "models"), "a1")
    events.writeStream.foreachBatch(install).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert loaded == ["a2"] and install.failures == []
    assert [stateful.backoff(0, 0), stateful.backoff(0, 1), stateful.backoff(0, 20), stateful.backoff(31, 16)] == [1, 2, 30, 1]
