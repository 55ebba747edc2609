from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.llm import packing, token_files
from segspark.llm.common import shared_dir
from segspark.llm.encode import Encoder, default_path

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_units_give_the_librarys_ids(plain):
    rng = random.Random(4)
    signs = "aB9é. ,\n_!'\0\x85\xa0́ ß×÷\t…“s<日٣²½​"
    texts = ["".join(rng.choices(signs, k=rng.randrange(14))) for _ in range(20_000)]
    texts += ["", " ", "it's, we'll. Don't", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y, z.\nw", "<|endoftext|", "A" + "<|endoftext|>" * 3, "1.5,2", "x" * 5000, "word " * 3000, " lead", "trail ", "a  b", "\n", "a.\nB", "Ünder. Él, ça."]
    e = Encoder(default_path())
    for _ in range(2):
        got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)]
        assert got == plain(texts)


def test_other_tokenizers_get_whole_texts(tmp_path):
    """A file with another pre-tokeniser, prefix space, normaliser or added word: the library's ids all the same."""
    import json

    from tokenizers import Tokenizer

    with open(default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    other = [
        spec | {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
        spec | {"normalizer": {"type": "Lowercase"}},
        spec | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, spec["pre_tokenizer"]]}},
        spec | {"added_tokens": [*spec["added_tokens"], {"id": 50257, "content": "word", "single_word": False, "lstrip": True, "rstrip": False, "normalized": True, "special": False}]},
    ]
    texts = ["Some words, and 1234 more.", "a word in it", "lead", "ALLCAPS", " x", "", "swordfish word."]
    for i, o in enumerate(other):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(o))
        e, t = Encoder(str(path)), Tokenizer.from_file(str(path))
        assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
        assert e.cuts == (i == 3)


def test_memory_is_bounded(monkeypatch, plain):
    from segspark.llm import encode

    monkeypatch.setattr(encode, "MAX_UNITS", 50)
    monkeypatch.setattr(encode, "FIRST_UNITS", 10)
    e = Encoder(default_path())
    for a in range(0, 400, 40):
        texts = [f"w{i} v{i % 7} common" for i in range(a, a + 40)]
        assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == plain(texts)
        assert len(e.units) <= 50 + 130


def test_nnls():
    a = np.array([[1.0, 0, 1], [0, 2, 1]])
    assert np.allclose(packing.nnls(a, np.array([3.0, 4])), [3, 2, 0]) or np.allclose(a @ packing.nnls(a, np.array([3.0, 4])), [3, 4])
    rng = np.random.default_rng(0)
    for _ in range(10):
        a, b = rng.random((8, 20)), rng.random(8)
        x = packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g < 1e-6).all() and abs(g @ x) < 1e-6


@pytest.mark.parametrize("counts", [{}, {5: 1}, {2047: 3}, {1500: 1000}, {1: 5000}, {1024: 7, 1023: 9}, {100: 3, 1948: 2, 700: 50}, "random", "few"])
def test_plan_covers_every_rest_once(counts):
    rng = np.random.default_rng(3)
    if isinstance(counts, str):
        v = rng.integers(1, 2048, 20_000 if counts == "random" else 30)
        counts = dict(zip(*(x.tolist() for x in np.unique(v, return_counts=True)), strict=True))
    rows, sequences = packing.plan(counts)
    cover = defaultdict(list)
    used = defaultdict(list)
    for length, offset, size, lo, hi, seq, place in rows.tolist():
        for r in range(lo, hi):
            cover[length, r].append((offset, size))
            used[seq + r - lo].append((place, size))
    assert set(cover) == {(n, r) for n, c in counts.items() for r in range(c)}
    for (n, _), parts in cover.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == n
    for parts in used.values():
        at = 0
        for place, size in sorted(parts):
            assert place == at
            at += size
        assert at <= packing.WINDOW
    assert set(used) == set(range(sequences))
    total = sum(n * c for n, c in counts.items())
    if sequences > 20:
        assert total / (sequences * packing.WINDOW) > 0.99


@pytest.mark.parametrize("shape", ["uniform", "log-normal", "short", "long"])
def test_solution_is_no_worse_than_the_greedy_rest_alone(shape, monkeypatch):
    """As few sequences as can be, and on lengths that pair up fewer cuts."""
    rng = np.random.default_rng(1)
    v = {"uniform": lambda: rng.integers(1, 2048, 50_000), "log-normal": lambda: np.clip(rng.lognormal(5.5, 1, 50_000), 1, 2047).astype(int), "short": lambda: rng.integers(1, 300, 20_000), "long": lambda: rng.integers(1200, 2048, 5000)}[shape]()
    counts = dict(zip(*(x.tolist() for x in np.unique(v, return_counts=True)), strict=True))
    rows, sequences = packing.plan(counts)
    monkeypatch.setattr(packing, "nnls", lambda a, b: np.zeros(a.shape[1]))
    greedy, alone = packing.plan(counts)
    assert sequences == -(-int(v.sum()) // packing.WINDOW) <= alone
    pieces, other = (int((r[:, 4] - r[:, 3]).sum()) for r in (rows, greedy))
    assert pieces - len(v) < (0.75 if shape == "uniform" else 1.2) * (other - len(v)) + 50


def check_pieces(rows, want: dict[int, list[int]]):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(docs) == set(want)
    for d, parts in docs.items():
        at = 0
        for start, length, c, tokens in sorted(parts):
            assert start == at and tokens == len(want[d]) and c == crc(want[d][start : start + length])
            at += length
        assert at == len(want[d])
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_query(spark, sf, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: ids + [1] for (d, _), ids in zip(rows, plain([t or "" for _, t in rows]), strict=True)}
    got = packing.op6(spark, sf).collect()
    check_pieces(got, want)
    assert sum(map(len, want.values())) > 0.98 * 2048 * len({r["sequence_id"] for r in got})


def test_packing_cases(spark, plain):
    texts = {1: None, 2: "", 3: "one word", 4: "a " * 9000, 5: "same text", 6: "same text", 7: "end<|endoftext|> start"}
    df = spark.createDataFrame(list(texts.items()), SCHEMA).withColumn("piece", F.lit("clash"))
    want = {d: ids + [1] for d, ids in zip(texts, plain([t or "" for t in texts.values()]), strict=True)}
    check_pieces(packing.pack(df).withColumn("ids_crc32", F.crc32("ids")).collect(), want)
    assert packing.pack(df.where("false")).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z")], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["length"]) for r in twice) == [(-1, 2), (1, 3), (1, 3)]


def test_token_files_query(spark, sf, plain):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, {}
    for (d, _), ids in zip(rows, plain([t or "" for _, t in rows]), strict=True):
        want[d] = (at, len(ids) + 1, crc([*ids, 0]))
        at += len(ids) + 1
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op10(spark, sf).collect()} == want


def test_keyed_access_and_cases(spark, plain):
    folder = f"{shared_dir(spark)}/tok-cases"
    token_files._open(folder)[0].create_dir(token_files._open(folder)[1], recursive=True)
    texts = {i: f"document number {i} " * (i % 9) for i in range(0, 600, 3)} | {1000: None, 1001: "", 1002: "a<|endoftext|>b"}
    rows = [*texts.items(), (3, texts[3]), (None, "no id")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).repartition(5)
    manifest = token_files.write_token_files(df, folder, shard_ids=300)
    assert len(manifest) > 8
    files = token_files.TokenFiles(manifest)
    for d, ids in zip(texts, plain([t or "" for t in texts.values()]), strict=True):
        assert files.get(d).tolist() == [*ids, 0]
    assert all(files.get(k) is None for k in (1, 2, 599, 5000, -9))
    assert files.get(-1).tolist() == [*plain(["no id"])[0], 0]
    # A key with more rows than a shard holds.
    hot = token_files.write_token_files(spark.createDataFrame([(8, f"hot text {i}") for i in range(400)] + [(7, "a"), (9, "b")], SCHEMA), folder, shard_ids=300)
    assert max(r["n_ids"] for r in hot) < 320 and sum(r["n_docs"] for r in hot) == 402
    found = token_files.TokenFiles(hot)
    assert found.get(8) is not None and found.get(7).tolist() == [*plain(["a"])[0], 0] and found.get(9).tolist() == [*plain(["b"])[0], 0]
    assert token_files.read_token_files(spark, hot).where("doc_id = 8").count() == 400
    back = token_files.read_token_files(spark, manifest).collect()
    assert len(back) == len(rows) and sum(r["doc_id"] == 3 for r in back) == 2
    assert sum(r["n_tokens"] for r in back) == max(r["start"] + r["n_tokens"] for r in back)
    assert token_files.read_token_files(spark, token_files.write_token_files(df.where("false"), folder)).count() == 0


def test_keyed_access_reads_a_few_bytes(tmp_path):
    """Whatever the number of keys: the head, 16 bytes a level, a slot, two bounds and the ids."""
    for n in (1000, 100_000):
        keys, lengths = np.arange(n) * 3, np.full(n, 2)
        (tmp_path / f"{n}.idx").write_bytes(token_files.ShardIndex.build(keys, lengths, 2).to_bytes())
        (tmp_path / f"{n}.bin").write_bytes(np.arange(2 * n, dtype="<u2").tobytes())
        files = token_files.TokenFiles([{"name": f"{tmp_path}/{n}", "n_docs": n, "first_key": 0, "last_key": 3 * n - 3}])
        read, real = [], token_files._open

        class Counted:
            def __init__(self, f):
                self.f = f

            def read_at(self, size, at):
                read.append(size)
                return self.f.read_at(size, at)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.f.close()

        class Where:
            def __init__(self, where):
                self.where = where

            def open_input_file(self, p):
                return Counted(self.where.open_input_file(p))

        token_files._open = lambda path: (Where(real(path)[0]), real(path)[1])  # noqa: B023
        try:
            for k in (0, 3, 3 * n - 3, 3 * (n // 2)):
                assert files.get(k).tolist() == [x & 0xFFFF for x in (2 * k // 3, 2 * k // 3 + 1)]
            assert sum(files.get(k) is not None for k in range(1, 3000, 3)) == 0
            read.clear()
            assert files.get(3 * (n // 3)) is not None
            assert sum(read) < 16 * 96 + 8 + 16 + 4 + 1 and len(read) < 20
        finally:
            token_files._open = real


def test_damaged_index_is_refused():
    index = token_files.ShardIndex.build(np.array([1, 5, 5, 9]), np.array([2, 3, 4, 1]), 2)
    again = token_files.ShardIndex.from_bytes(index.to_bytes())
    assert again.find(np.array([1, 5, 9, 2])).tolist() == [0, 1, 3, -1]
    with pytest.raises(ValueError):
        token_files.ShardIndex.from_bytes(b"XXXX" + index.to_bytes()[4:])
