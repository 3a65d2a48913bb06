"""Sources, sinks, index/label plans and sampling invariants."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cadenza.operators import sampling as S
from cadenza.operators.lexicon import full_lexicon, lexicon_from_json_column
from cadenza.plans.dataset import attach_lyrics, quadrant_expr
from cadenza.plans.index import index_songs
from cadenza.sources import files as FS
from cadenza.sources import sinks as SK


def test_text_corpus_encodings(spark):
    d = tempfile.mkdtemp(prefix="cadenza-corpus-")
    with open(os.path.join(d, "a.txt"), "w", encoding="utf-8") as f:
        f.write("hello\nworld\n123")
    with open(os.path.join(d, "b.txt"), "wb") as f:
        f.write("héllo".encode("utf-16"))
    with open(os.path.join(d, "c.txt"), "wb") as f:
        f.write(b"\xc3\x28 bad")
    got = {r["lyrics_filename"]: (r["lyrics"], r["encoding"]) for r in FS.read_text_corpus(spark, d).collect()}
    assert got["a"] == ("hello\nworld\n123", "utf-8")
    assert got["b"] == ("héllo", "utf-16")
    assert got["c"] == (None, "none")


def test_missing_file_gives_empty(spark):
    songs = spark.createDataFrame([("x", "bbb___aaa"), ("y", "nope")], "msd_id string, lyrics_filename string")
    corpus = spark.createDataFrame([("bbb___aaa", "la la")], "lyrics_filename string, lyrics string")
    got = {r["msd_id"]: r["lyrics"] for r in attach_lyrics(songs, corpus).collect()}
    assert got == {"x": "la la", "y": ""}


def test_index_golden_semantics(spark):
    schema = ("msd_id string, msd_artist string, msd_title string, is_english int, "
              "lyrics_available int, wordcount int, lyrics_filename string")
    mapping = spark.createDataFrame([
        ("1", "10cc", "I'm Not In Love", -1, -1, -1, "-1"),
        ("2", "10cc", "Woman In Love", 0, -1, -1, "aaa"),
        ("3", "apple", "orange", -1, -1, -1, ""),
        ("4", "zed", "done", 1, 1, 5, "zed___done"),
    ], schema)
    corpus = spark.createDataFrame([
        ("10cc___Im_Not_In_Love", "a b c", "en"),
        ("10cc___Woman_In_Love", "x y", "en"),
    ], "lyrics_filename string, lyrics string, lang string")
    out = {r["msd_id"]: r for r in index_songs(mapping, corpus).collect()}
    assert (out["1"]["is_english"], out["1"]["lyrics_available"], out["1"]["wordcount"],
            out["1"]["lyrics_filename"]) == (1, 1, 3, "10cc___Im_Not_In_Love")
    assert (out["2"]["lyrics_available"], out["2"]["wordcount"]) == (1, 2)
    assert (out["3"]["is_english"], out["3"]["lyrics_available"], out["3"]["wordcount"],
            out["3"]["lyrics_filename"]) == (0, 0, 0, "apple___orange")
    assert out["4"]["wordcount"] == 5  # already processed: untouched
    again = index_songs(index_songs(mapping, corpus), corpus)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index_songs(mapping, corpus).collect()))


def test_lexicon_json_roundtrip(spark):
    lex = full_lexicon()
    doc = spark.createDataFrame([(lex.to_json(),)], "value string")
    rows = lexicon_from_json_column(doc).collect()
    got = {(r["mood"], r["kind"], r["term_ord"], r["term"]) for r in rows}
    want = {(m, k, i, t) for m in lex.moods_sorted
            for k, terms in enumerate([lex.exact[m], lex.like[m], lex.filters[m]])
            for i, t in enumerate(terms)}
    assert got == want
    assert len(rows) == 75 + 70 + 317


def test_overwrite_guard_and_append(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="cadenza-sink-"), "t")
    df = spark.range(3)
    SK.write_table(df, path)
    with pytest.raises(Exception):
        SK.write_table(df, path)
    SK.write_table(df, path, append=True)
    assert spark.read.parquet(path).count() == 6
    SK.write_table(df, path, overwrite=True)
    assert spark.read.parquet(path).count() == 3


def test_stage_reuse(spark):
    root = tempfile.mkdtemp(prefix="cadenza-stage-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    a = SK.stage(spark, "s", {"k": 1}, build, root=root)
    b = SK.stage(spark, "s", {"k": 1}, build, root=root)
    assert a.count() == b.count() == 5 and len(calls) == 1
    SK.stage(spark, "s", {"k": 2}, build, root=root)
    assert len(calls) == 2


def test_quadrants(spark):
    moods = ["aggression", "angst", "anger", "excitement", "upbeat", "cheerful", "happy",
             "depressed", "sad", "grief", "calm", "confident", "dreamy"]
    df = spark.createDataFrame([(m,) for m in moods], "mood string")
    got = [r["q"] for r in df.select(quadrant_expr(F.col("mood")).alias("q")).collect()]
    assert got == ["anger"] * 3 + ["happy"] * 4 + ["sad"] * 3 + ["calm"] * 2 + ["dreamy"]


def test_balance_classes_equalises(spark):
    rows = [(i, "a" if i < 7 else ("b" if i < 9 else "c"), f"l{i}\nm{i}\nn{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "k long, mood string, lyrics string")
    out = S.balance_classes(df, "mood", F.col("k"))
    sizes = {r["mood"]: r["count"] for r in out.groupBy("mood").count().collect()}
    assert sizes == {"a": 7, "b": 7, "c": 7}
    orig = out.where("copy = 0").count()
    assert orig == 10
    # copies keep their lines, only reordered
    for r in out.where("copy > 0").collect():
        assert sorted(r["lyrics"].split("\n")) == sorted(rows[r["k"]][2].split("\n"))


def test_sep_parse(spark):
    lines = spark.createDataFrame([("# header",), ("a<SEP>b<SEP>c<SEP>d<SEP>e<SEP>f  ",), ("x<SEP>y",)],
                                  "value string")
    ok, rej = FS.parse_sep_lines(lines)
    assert [tuple(r) for r in ok.collect()] == [("a", "b", "c", "d", "e", "f")]
    assert [(r["line"], r["n_fields"]) for r in rej.collect()] == [("x<SEP>y", 2)]


def test_balance_many_copies(spark):
    rows = [(i, "a" if i < 20 else "b", f"x{i}") for i in range(21)]
    df = spark.createDataFrame(rows, "k long, mood string, lyrics string")
    out = S.balance_classes(df, "mood", F.col("k"))
    sizes = {r["mood"]: r["count"] for r in out.groupBy("mood").count().collect()}
    assert sizes == {"a": 20, "b": 20}
    copies = sorted(r["copy"] for r in out.where("mood = 'b'").collect())
    assert copies == list(range(20))


def test_skipgram_pairs_brute_force(spark):
    from cadenza.operators import pairs as PA

    docs = [(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, []), (4, ["p", "q"])]
    df = spark.createDataFrame(docs, "doc_id long, t array<string>")
    for w in (1, 2, 3):
        got = sorted(tuple(r) for r in PA.skipgram_pairs(df, F.col("t"), w).collect())
        exp = sorted((d, i, t[i], t[j]) for d, t in docs for i in range(len(t))
                     for j in range(max(0, i - w), min(len(t), i + w + 1)) if j != i)
        assert got == exp
    sampled = PA.skipgram_sampled(df, F.col("t"), skip_window=2, num_skips=2).collect()
    per_centre = {}
    for r in sampled:
        per_centre.setdefault((r["doc_id"], r["pos"]), []).append(r["context"])
    assert all(len(v) <= 2 for v in per_centre.values())
    assert len(per_centre[(1, 0)]) == 2


def test_seeded_cut_equals_exact_rank(spark):
    """The boundary-bucket cut gives the same labels as cutting the exact
    per-partition rank, for several sizes and one hex digit (16 buckets, so
    many rows share a bucket and the boundary ranking is exercised)."""
    import random

    rnd = random.Random(7)
    rows = [(i, rnd.choice(["a", "b", "c"])) for i in range(0, 3000, 3)]
    df = spark.createDataFrame(rows, "k long, g string")
    cut = S.seeded_cut(df, F.col("k"), 5, ["lo", "mid", "hi"],
                       lambda off: [F.floor(F.col("_t") * 0.3), F.floor(F.col("_t") * 0.75)],
                       partition=["g"], hex_digits=1, label_col="lab")
    ranked = S.global_rank(df, F.col("k"), 5, partition=["g"], hex_digits=1, size_col="n")
    exp = ranked.select("k", F.when(F.col("rank") < F.floor(F.col("n") * 0.3), "lo")
                        .when(F.col("rank") < F.floor(F.col("n") * 0.75), "mid").otherwise("hi").alias("lab"))
    got = {r["k"]: r["lab"] for r in cut.select("k", "lab").collect()}
    want = {r["k"]: r["lab"] for r in exp.collect()}
    assert len(got) == len(rows) and got == want


def test_epoch_batches_invariants(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = S.epoch_batches(df, F.col("k"), epochs=2, batch_size=4, seed=3).collect()
    for e in (1, 2):
        rows = [r for r in out if r["epoch"] == e]
        assert sorted(r["position"] for r in rows) == list(range(10))
        assert len({r["batch"] for r in rows}) == int((10 - 1) / 4) + 1
    orders = [[r["k"] for r in sorted((r for r in out if r["epoch"] == e), key=lambda r: r["position"])]
              for e in (1, 2)]
    assert orders[0] != orders[1]


def test_histogram_degenerate_range(spark):
    from cadenza.operators import tags as T

    counts = spark.createDataFrame([("a", 5), ("b", 5)], "tag string, n_songs long")
    rows = {r["bin"]: r["n"] for r in T.tag_histogram(counts).collect()}
    assert rows[0] == 2 and sum(rows.values()) == 2 and len(rows) == 10


def test_null_class_is_balanced_and_cut(spark):
    """NULL is a class of its own: its rows stay, are oversampled, and are cut like any other."""
    rows = [(i, "a" if i < 8 else None, f"l{i}\nm{i}") for i in range(11)]
    df = spark.createDataFrame(rows, "k long, mood string, lyrics string")
    out = S.balance_classes(df, "mood", F.col("k")).collect()
    assert sum(r["mood"] is None for r in out) == sum(r["mood"] == "a" for r in out) == 8
    assert sorted(r["k"] for r in out if r["copy"] == 0) == list(range(11))
    cut = S.seeded_cut(df, F.col("k"), 1, ["in", "out"], lambda off: [F.floor(F.col("_t") / 2)], partition=["mood"]).collect()
    assert sum(r["mood"] is None and r["cut"] == "in" for r in cut) == 1
    assert sum(r["mood"] == "a" and r["cut"] == "in" for r in cut) == 4
    kept = S.downsample_class(df, "mood", "a", F.col("k")).collect()
    assert sum(r["mood"] is None for r in kept) == 3 and sum(r["mood"] == "a" for r in kept) == 4


def test_cut_in_one_bucket_and_beyond_the_end(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    for thr, want in ((0, 0), (7, 7), (20, 20), (99, 20)):
        cut = S.seeded_cut(df, F.col("k"), 3, ["in", "out"], lambda off, thr=thr: [F.lit(thr)], hex_digits=1)
        assert cut.where("cut = 'in'").count() == want
    assert S.seeded_cut(df.limit(0), F.col("k"), 3, ["in", "out"], lambda off: [F.lit(1)]).collect() == []


def test_split_does_not_shuffle_wide_rows(spark):
    """With static broadcasts off no exchange above the scan carries the text."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
        for out in (S.three_way_split(d, F.col("doc_id")), S.balance_classes(d, "lang", F.col("doc_id"), "text"),
                    S.downsample_class(d, "lang", "en", F.col("doc_id"))):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
