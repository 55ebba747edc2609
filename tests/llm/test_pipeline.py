from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from segspark.llm import queries
from segspark.llm.common import read
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_similar import brute as brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs, seen = read(spark, sf, "documents"), []
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r for r in out.collect()}
        texts = [(d, r["text"]) for d, r in before.items()]
        if name != "packing":
            assert out.columns == COLUMNS and all(r["n_chars"] == len(r["text"] or "") for r in after.values())
        if name == "language_id":
            gone = [before[d]["text"] for d in before.keys() - after.keys()]
            assert len(gone) < 0.05 * len(before)
            assert not any((r["text"] or "").strip() == "" for r in after.values())
        elif name == "line_dedup":
            assert {d: r["text"] for d, r in after.items()} == {d: t for d, (_, _, t) in brute_lines(texts).items()}
        elif name == "near_dedup":
            roots = brute_components(dict(texts))  # at a similarity of 0.8 over five-word shingles
            assert set(after) == {d for d, c in roots.items() if d == c}
        elif name == "benchmark_decontamination":
            hits = brute_hits(texts, [tuple(r) for r in read(spark, sf, "benchmark").select("item_id", "text").collect()])
            assert set(after) == {d for d, h in hits.items() if not h[4]}
        else:
            assert {r["doc_id"] for r in out.collect()} == set(before)
            assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
        seen.append(name)
        docs = out
    assert len(seen) == 5


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 100


def test_empty_documents(spark, sf, tmp_path):
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, read(spark, sf, "documents").where("false"), sf)
        assert out.columns == COLUMNS and out.count() == 0, name
    assert pipeline.STAGES[4][1](spark, read(spark, sf, "documents").where("false"), sf).count() == 0


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns with names that the operators use."""
    plain = "The house stood by the river, and the old man who lived there went down to the water every day. "
    item = read(spark, "/root/testdata/sf0.001", "benchmark").where("length(text) > 200").orderBy("item_id").first()["text"]
    rows = [
        (1, plain * 2, "en", "a", 1), (2, None, "en", "a", 2), (3, "", None, None, None), (4, "12 34 !!", "en", "b", 4), (None, plain + "No one knew.", None, None, None),
        (5, plain * 2, "en", "a", 5), (5, plain * 2, "en", "a", 5), (6, "word and more of it " * 40_000, "en", "c", 6), (7, item, "en", "d", 7), (8, plain + "More text of its own, in its own words.", None, "e", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("shard", "piece", "fp", "spans", "drops", "row", "key", "score", "carried", "hit_id")
    return df.select("*", *[F.lit("clash").alias(c) for c in clash]), len(rows)


def test_stages_on_odd_rows(spark, sf, tmp_path):
    docs, n = odd_rows(spark)
    model = read(spark, sf, "documents").where("lang is not null").withColumn("doc_id", F.col("doc_id") + 1000)
    both = docs.unionByName(model, allowMissingColumns=True)
    kept = pipeline.language_id(spark, both, sf)
    assert kept.columns == COLUMNS
    ids = [r["doc_id"] for r in kept.where("doc_id < 100").collect()]
    assert sorted(ids) == [-1, 1, 5, 5, 6, 7, 8]  # texts without a letter go; repeated rows stay
    lines = pipeline.line_dedup(spark, docs, sf)
    assert lines.columns == COLUMNS and lines.count() == n and lines.where("text is null").count() == 0
    near = pipeline.near_dedup(spark, docs, sf)
    assert near.columns == COLUMNS
    # 5 is a copy of 1, 3 (empty) one of 2 (null); rows of one id stay or go together.
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in near.collect()) == [-1, 1, 2, 4, 6, 7, 8]
    clean = pipeline.benchmark_decontamination(spark, docs, sf)
    assert clean.columns == COLUMNS and 7 not in {r["doc_id"] for r in clean.collect()} and clean.count() == n - 1
    packed = pipeline.packing(spark, docs, sf)
    assert packed.where("start = 0").count() == n and packed.agg(F.max("length")).first()[0] <= 2048
    ends = {r["doc_id"]: r["doc_tokens"] for r in packed.collect()}
    assert ends[2] == ends[3] == 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, df.select(names).rdd.map(tuple).collect())) == sorted(map(repr, want.fetchall()))
