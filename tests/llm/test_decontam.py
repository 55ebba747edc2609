from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from segspark.llm import decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items, n=13):
    grams: dict[tuple, set] = {}
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - n + 1)) if ws else ():
            grams.setdefault(tuple(ws[k : k + n]), set()).add(str(i))
    sizes = {len(g) for g in grams}
    out = {}
    for d, t in docs:
        ws, hit, of = words(t), set(), set()
        for k in range(len(ws)):
            for m in sizes:
                if k + m <= len(ws) and (got := grams.get(tuple(ws[k : k + m]))):
                    hit |= set(range(k, k + m))
                    of |= got
        out[d] = (len(ws), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))
    return out


def found(df, bench, **k):
    f = decontam.contaminated_spans(df, bench, **k)
    return {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), r["contaminated"]) for r in f.collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["a", "b", "ab", "É", "7", "cd", "x\x85y"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 3, 12, 13, 14, 30))))) for i in range(12)] + [(50, None), (51, "!!")]
    docs = []
    for d in range(60):
        t = rng.choices(vocabulary, k=rng.randrange(60))
        if d % 2:
            ws = (items[rng.randrange(12)][1] or "").split()
            at = rng.randrange(len(t) + 1)
            t[at:at] = ws[rng.randrange(3) :]
        docs.append((d, rng.choice((" ", "-", "\n")).join(t).upper() if d % 3 else " ".join(t)))
    docs += [(100, None), (101, ""), (102, "...")]
    items = [x for x in items if len((x[1] or "").split()) != 1]
    df, bench = spark.createDataFrame(docs, DOCS).withColumn("spans", F.lit("clash")), spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(1))
    want = brute(docs, items)
    assert found(df, bench) == want
    assert found(df, bench, limit=100) == want  # several blocks, and more than go out at a time
    assert len(list(decontam.blocks(iter([(str(i), t) for i, t in items]), 13, 100))) > decontam.MAX_BLOCKS
    again = df.union(df).union(spark.createDataFrame([(None, docs[1][0]), (1, docs[3][0])], DOCS).withColumn("spans", F.lit("x")))
    many = decontam.contaminated_spans(again, bench, limit=100)
    assert many.count() == 2 * len(docs) + 2
    monkeypatch.setattr(decontam, "MAX_BLOCKS", 100)
    assert found(df, bench, limit=100) == want  # all at once
    assert sum(x[4] for x in want.values()) > 5


def test_one_word_item_and_empty_tables(spark):
    docs, items = [(1, "some word here"), (2, "other")], [(9, "Word")]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert found(df, bench) == brute(docs, items)
    assert found(df, bench.where("false")) == brute(docs, [])
    assert found(df.where("false"), bench) == {}
    assert decontam.contaminated_spans(df.union(df), bench).count() == 4


def test_removal(spark):
    bench = spark.createDataFrame([(1, "one two three")], ITEMS)
    df = spark.createDataFrame([(1, "Ä! One, two;three -- four."), (2, "clean"), (3, None), (4, "one two three")], DOCS)
    spans = {r["doc_id"]: r["text"] for r in decontam.decontaminate(df, bench, "span").collect()}
    assert spans == {1: "Ä!  -- four.", 2: "clean", 3: None, 4: ""}
    assert {r["doc_id"] for r in decontam.decontaminate(df, bench).collect()} == {2, 3}


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.op9(spark, sf).collect()}
    assert got == brute(docs, items)
    plan = decontam.op9(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
