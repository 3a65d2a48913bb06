"""Findings of round 4: memory of the driver, disk and time of four queries."""

from __future__ import annotations

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from cadenza.operators import embeddings as EM
from cadenza.operators import models as MO
from cadenza.sources import files as FS


def test_local_corpus_is_listed_by_tasks(spark, tmp_path):
    texts = {"a/b/one.txt": b"one\n", "a/two.txt": "zwei ä\n".encode(), "three.txt": b"", "a/b/c/four.txt": "vier".encode("utf-16"),
             "x=1/five.txt": b"\xff\x00", "_k=v/six.txt": b"six", "a/ odd %41 name.txt": b"odd", "_hidden/seven.txt": b"7", ".eight.txt": b"8",
             "a/nine.TXT": b"9", "a/ten.txt._COPYING_": b"10", "_metadata.txt": b"11", "a/twelve.csv": b"12"}
    for name, text in texts.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/c/{name}"), exist_ok=True)
        with open(f"{tmp_path}/c/{name}", "wb") as f:
            f.write(text)
    got = FS.read_text_corpus(spark, f"{tmp_path}/c")
    # Spark's file scan keeps a list of all files on the driver
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(f"{tmp_path}/c"))
    want = sorted(r[0] for r in raw.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).collect())
    assert sorted(r["lyrics_filename"] for r in got.collect()) == want and len(want) == 6
    assert FS.read_text_corpus(spark, f"{tmp_path}/c", glob="t*.txt").count() == 1
    one = FS.read_text_corpus(spark, f"{tmp_path}/c", glob="{one,two}.txt")  # Spark's reader knows more globs
    assert sorted(r["lyrics_filename"] for r in one.collect()) == ["one", "two"]


def test_windows_are_made_where_the_tokens_are(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(9)]
    vecs = spark.createDataFrame([(w, [rng.uniform(-1, 1) for _ in range(3)]) for w in [*words, "UNK"]], "word string, vec array<double>")
    rows = [(i, [rng.choice([*words, "other", None]) for _ in range(rng.randrange(0, 12))]) for i in range(60)]
    rows += [(60, None), (70, ["w1", "w2"]), (70, ["w1", "w2"]), (None, ["w1"]), (None, []), (61, ["w1"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    monkeypatch.setattr(MO, "RUN_NUMBERS", 15)  # runs of five windows: a document is cut and put together again

    def of(df):
        return {r["doc_id"]: [round(x, 9) for x in r["features"]] for r in df.collect()}

    want = of(MO._joined_windows(docs, "tokens", vecs, 3, (3, 4, 5)))
    assert of(MO.window_features(docs, "tokens", vecs, 3, (3, 4, 5))) == want and len(want) == 64
    some = docs.where("doc_id < 70")
    plan = MO.window_features(some, "tokens", vecs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # no token row is shuffled or sorted
    monkeypatch.setattr(MO, "HELD_NUMBERS", 6)  # more vectors than a task may hold are joined
    assert of(MO.window_features(docs, "tokens", vecs, 3, (3, 4, 5))) == want


def test_a_pair_is_shuffled_once_a_task(spark, monkeypatch):
    rng = random.Random(5)
    texts = [[rng.randrange(30) for _ in range(rng.randrange(0, 20))] for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "ids array<int>").coalesce(1)
    want = Counter()
    for t in texts:
        for i, a in enumerate(t):
            for b in t[i + 1: i + 5]:
                want[a, b] += 1
                want[b, a] += 1
    cut = EM.stacks
    monkeypatch.setattr(EM, "stacks", lambda column: cut(column, 100))
    pairs = EM.id_pairs(docs, F.col("ids"), 4)
    assert {(r["centre"], r["context"]): r["n"] for r in pairs.collect()} == want
    assert [t for _, t in pairs.dtypes] == ["int", "int", "bigint"]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "keys=[pair#" in plan and "keys=[centre#" not in plan  # one number a pair, of either order
    monkeypatch.setattr(EM, "PAIRS", 50)  # few are held: they are handed on in between
    monkeypatch.setattr(EM, "HANDED", 7)
    assert {(r["centre"], r["context"]): r["n"] for r in EM.id_pairs(docs, F.col("ids"), 4).collect()} == want
