"""The pipeline against its operators applied by hand, on a small corpus."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from reuselens.llm import textstats

from .test_operators import DOCS, ITEMS, LABELS, brute_groups, brute_hits, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(20)
    rows = []
    for k in range(160):
        kind = k % 8
        text = prose(r, r.randint(60, 140))
        if kind == 1:
            text = text.replace(" ", "### ")
        elif kind == 2:
            text = (prose(r, 6) + " ") * 20
        rows.append((k, text))
    items = [(k, prose(r, 25)) for k in range(5)]
    rows += [(200 + k, rows[8 * k][1] + " extra") for k in range(10)] + [(300 + k, rows[8 * k + 3][1]) for k in range(10)]
    rows += [(400 + k, prose(r, 80) + " " + items[k % 5][1]) for k in range(10)] + [(500, None), (501, ""), (502, "short"), (503, prose(r, 9000))]
    # whole items in long documents, under a twentieth of the words
    rows += [(600 + k, prose(r, 600) + " " + items[k][1] + " " + prose(r, 600)) for k in range(5)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 8 not in (1, 2)), 0) for k in range(160)], LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{at}/benchmark.parquet")
    return at, dict(rows), items


def test_stages_equal_brute_force(spark, corpus):
    at, texts, items = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        kept[name] = sorted(x["doc_id"] for x in out.select("doc_id").collect())
        docs = spark.createDataFrame(out.collect(), out.schema)
    clean = {k for k in texts if k < 160 and k % 8 not in (1, 2)} | {k for k in texts if k >= 200 and len((texts[k] or "").split()) > 50}
    assert clean <= set(kept["quality_classifier"]) and not {k for k in kept["quality_classifier"] if k < 160 and k % 8 in (1, 2)}
    measured = {k: dict(zip(textstats.FIELDS, textstats.measure((texts[k] or "").encode()), strict=True)) for k in texts}
    assert set(kept["quality_rules"]) == {k for k in kept["quality_classifier"] if measured[k]["n_words"] >= 50}
    groups = brute_groups([(k, texts[k]) for k in kept["quality_rules"]], 5, 80, 100)
    assert set(kept["near_dedup"]) == {i for i, _, c in groups if i == c}
    dirty = {k for k in kept["near_dedup"] for _, hit, _, _ in [brute_hits(texts[k], items)] if hit}
    assert dirty >= set(range(600, 605)) and set(kept["decontamination"]) == set(kept["near_dedup"]) - dirty == set(kept["sentencepiece"])


def test_run(spark, corpus):
    at, texts, _ = corpus
    got = corpus_pipeline.run(spark, at)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = {x["doc_id"]: x for x in got.collect()}
    want = {x["doc_id"]: x["h"] for x in spark.createDataFrame([(k, texts[k]) for k in rows], "doc_id bigint, text string").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()}
    assert rows and all(x["decoded_sha256"] == want[k] for k, x in rows.items())


def test_odd_rows_and_clashing_names(spark, corpus, tmp_path):
    """Null ids and texts, repeated rows, long texts and columns that an operator might use itself, through every stage."""
    at, texts, _ = corpus
    clash = "word bits hits score kept n digest node leader rep h _set _same measured failed_rules block_hits".split()
    plain = texts[0]
    rows = [(1001, plain), (1001, plain), (1002, plain), (None, plain), (None, plain), (None, None), (1003, None), (1003, None), (1004, "word " * 30_000), (1005, texts[8]), (1005, texts[16])]
    labelled = [(k, t) for k, t in texts.items() if 16 < k < 160]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows + labelled], DOCS).select("*", *[F.lit("mine").alias(c) for c in clash]).repartition(7)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        got = out.collect()
        counts[name] = sorted((x["doc_id"] or 0) for x in got if (x["doc_id"] or 1001) > 1000)
        if name != "sentencepiece":
            assert out.columns == docs.columns, name
            assert all(x[c] == "mine" for x in got for c in clash), (name, got[:1])
            docs = spark.createDataFrame(got, out.schema).repartition(5)
    assert counts["near_dedup"] == counts["decontamination"] == counts["sentencepiece"] == [0, 0, 1001, 1005, 1005], counts


def test_empty_corpus(spark, corpus, tmp_path):
    at, _, _ = corpus
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
