from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from segspark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_escape_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(5)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "[", "|", "\n", "é", "a", "</s", "INST]", "$1", ""]
    texts = ["".join(rng.choices(parts, k=rng.randrange(8))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("u", chat.unescape(F.col("e"))).collect()
    for r in rows:
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in chat.CONTROL)


def test_every_reply_is_a_target_once(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "</s>[INST]"), (1, 2, "assistant", "a\\b"), (1, 3, "user", "q"), (1, 4, "assistant", ""), (1, 5, "user", "tail"), (2, 0, "user", None), (None, 0, "assistant", "n"), (3, None, None, "x"), (3, 0, "ro\nle", "y")]
    got = chat.format_chats(spark.createDataFrame(turns, SCHEMA).withColumn("ts", F.lit("clash")))
    rows = {(r["conv_id"], r["example"]): r for r in got.withColumn("turns", chat.parse_turns(F.col("formatted"))).collect()}
    assert [(rows[1, i]["n_turns"], rows[1, i]["trainable"]) for i in range(3)] == [(3, True), (5, True), (6, False)]
    r = rows[1, 0]
    assert r["formatted"][r["loss_start"] : r["loss_end"]] == "a\\\\b"
    assert rows[1, 1]["loss_start"] == rows[1, 1]["loss_end"]
    assert [(t["role"], t["text"]) for t in rows[1, 2]["turns"]] == [(t[2], t[3]) for t in turns[:6]]
    assert [(t["role"], t["text"]) for t in rows[2, 0]["turns"]] == [("user", "")] and not rows[2, 0]["trainable"]
    assert rows[None, 0]["trainable"]
    assert [(t["role"], t["text"]) for t in rows[3, 0]["turns"]] == [("", "x"), ("ro\nle", "y")]


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_brute_force(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by: dict = {}
    for c, t, role, text in sorted(turns):
        by.setdefault(c, []).append((role, text or ""))
    got = {r["conv_id"]: r for r in chat.op1(spark, sf).collect()}
    assert set(got) == set(by)
    for c, ts in by.items():
        said = "".join(t for r, t in ts if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha(said))


def test_main_path_is_native(spark, sf):
    plan = chat.op1(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning(conv_id") == 1
