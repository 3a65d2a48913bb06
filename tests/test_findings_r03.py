"""Findings of round 3: joins of few keys, a task's share of the counted rows, tables that are read or stored whole."""

import os

import pytest
from cadenza.operators import embeddings as EM
from cadenza.operators import features as FE
from cadenza.operators import lookups as LK
from cadenza.operators import pairs as PA
from cadenza.operators import vocab as V
from cadenza.registry import published as P
from cadenza.sources import files as FS
from cadenza.sources import sinks as SK
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_meets_one_entry_of_a_title(spark):
    """F4, F9"""
    mapping = spark.createDataFrame([(f"P{i}", "a", "t", str(i), "A" if i % 2 else "a", "t") for i in range(20)] + [("P99", "x", "y", "", "x", "y")],
                                    ", ".join(f"{c} string" for c in LK.MAPPING_COLUMNS))
    entries = spark.createDataFrame([("t", "a", f"C{i}") for i in range(10, 40)] + [("t", "A", "C0"), ("t", None, "C1")],
                                    "title string, artist string, catalogue_id string")
    found, misses = LK.fallback_lookup(mapping, entries)
    assert {tuple(r) for r in found.collect()} == {(f"P{i}", 1, "C10") for i in range(20)}
    assert [r["msd_id"] for r in misses.collect()] == ["P99"]
    joined = plan(found)
    assert "Aggregate [title" in joined[joined.index("Join"):]


def test_counted_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    """F6, F12, F14 to F17, F19, F22"""
    spark.createDataFrame([(i, f"some words of text {i}") for i in range(500)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    monkeypatch.setattr(SK, "DEAL_BYTES", SK.input_bytes(d) // 50)
    assert SK.deal(d, "doc_id").rdd.getNumPartitions() in (50, 51)
    assert "numpartitions=5" in FE.term_counts(d)._jdf.queryExecution().executedPlan().toString().lower() or \
        "REPARTITION_BY_NUM" in FE.term_counts(d)._jdf.queryExecution().executedPlan().toString()
    assert FE.term_counts(d).count() == 2490  # one digit is no term


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_words_are_counted_in_stacks(spark, limit, monkeypatch):
    """F23"""
    monkeypatch.setattr(V.stacks, "__defaults__", (limit,))
    rows = [(i, [f"w{(i * j) % 5}" for j in range(i)]) for i in range(12)] + [(20, None), (21, [])]
    d = spark.createDataFrame(rows, "doc_id long, t array<string>")
    got = V.batch_counts(d, F.col("t")).groupBy("word").agg(F.sum("n")).collect()
    want = [w for _, t in rows for w in t or []]
    assert {tuple(r) for r in got} == {(w, want.count(w)) for w in want}


def test_vocabulary_reads_the_texts_once(spark, tmp_path):
    """F13, F23"""
    spark.createDataFrame([(1, "b a a c"), (2, "c a")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    vocab = V.vocabulary(V.batch_counts(d, F.split("text", " ")), 3)
    assert [tuple(r) for r in vocab.orderBy("word_id").collect()] == [(0, "UNK", 1), (1, "a", 3), (2, "c", 2)]
    assert vocab.inputFiles() and all("word-counts" in f for f in vocab.inputFiles())


def test_tags_of_texts_are_matched_before_they_are_shuffled(spark, tmp_path):
    """F2, F8, F10, F11"""
    rows = [(1, "Happy happy\n days of happy days", "en", "s", 1), (2, "x y", "en", "s", 1), (2, "y x y sad", "en", "s", 1),
            (3, None, "en", "s", 1), (4, "", "en", "s", 1), (None, "sad", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    tags = {}
    for i, text, *_ in rows:
        w = (text or "").lower().split()
        tags.setdefault(i, set()).update(w, (f"{a} {b}" for a, b in zip(w, w[1:])))
    store = P.word_tags(spark, str(tmp_path))
    assert {tuple(r) for r in store.found.collect()} == {(i, len(t)) for i, t in tags.items() if i and t}
    sad = store.rows(lambda tag: tag.contains("sad")).where("tid_id IS NOT NULL").select("tid_id", "tag_id").collect()
    assert {tuple(r) for r in sad} == {(2, "sad"), (2, "y sad")}
    labels = P.q_label_full_lexicon(spark, str(tmp_path))
    assert {(r["tid_id"], r["found_tags"]) for r in labels.collect()} == {(i, len(t) if i else 0) for i, t in tags.items()}


def test_id_pairs_are_counted_before_they_are_rows(spark):
    """F3, F20"""
    d = spark.createDataFrame([(1, [1, 2, 3, 1, 2]), (2, [5]), (3, []), (3, None), (4, [7, 7, 0, 1] * 50)], "doc_id int, ids array<int>")
    got = EM.id_pairs(d, F.col("ids"), 4)
    want = PA.pair_counts(PA.skipgram_pairs(d, F.col("ids"), 4, kind="int"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in plan(got)


@pytest.mark.parametrize("local", [True, False])
def test_corpus_files_are_spread_over_folders(spark, tmp_path, monkeypatch, local):
    """a file of each name and task; local ones have no checksum files, which start processes of their own."""
    if not local:
        fs = SK._fs
        monkeypatch.setattr(SK, "_fs", lambda s, p: (fs(s, p)[0], type("Other", (), {"getScheme": lambda self: "other"})()))
    rows = [(f"n{i}", f"text {i}\né") for i in range(40)] + [("n1", "again"), (None, "nameless"), ("empty", None)]
    d = spark.createDataFrame(rows, "lyrics_filename string, lyrics string").coalesce(1)
    for _ in range(2):  # the second run replaces the first
        SK.write_text_corpus(d, f"{tmp_path}/c")
    folders = [f for f in os.listdir(f"{tmp_path}/c") if f.startswith("folder=")]
    assert 20 < len(folders) < 43
    files = [f for *_, names in os.walk(f"{tmp_path}/c/") for f in names]
    assert len([f for f in files if f.endswith(".txt")]) == 42
    assert not local or not [f for f in files if f.startswith(".")]
    got = FS.read_text_corpus(spark, f"{tmp_path}/c", name_pattern=r"lyrics_filename=([^/]+)/[^/]+$")
    got = {r["lyrics_filename"]: r["lyrics"] for r in got.collect()}
    assert set(got.pop("n1").split("\n")) == {"text 1", "é", "again", ""}
    assert got.pop(SK.NO_NAME) == "nameless\n" and got.pop("empty") == "\n"
    assert got == {f"n{i}": f"text {i}\né\n" for i in range(40) if i != 1}


@pytest.mark.parametrize("window,skips", [(1, 1), (2, 2), (2, 4), (3, 2), (1, 0)])
def test_sampled_pairs_are_counted_in_stacks(spark, tmp_path, monkeypatch, window, skips):
    """F21"""
    monkeypatch.setattr(PA, "CENTRES", 4)
    rows = [(i, [f"w{(i * j) % 5}" for j in range(i)]) for i in range(12)] + [(20, None), (21, []), (None, ["a", "b", "c", "d", "a"]), (11, ["é", None, "é", "x"])]
    spark.createDataFrame(rows, "doc_id long, t array<string>").coalesce(1).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    got = PA.counted_samples(d, F.col("t"), window, skips, 7)
    want = PA.pair_counts(PA.skipgram_sampled(d, F.col("t"), window, skips, 7))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Generate" not in plan(got)
