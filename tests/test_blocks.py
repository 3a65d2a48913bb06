"""Findings of round 3 on the models over term features: features that stay in blocks of documents."""

import numpy as np
import pytest
from cadenza.operators import blocks as BL
from cadenza.operators import features as FE
from cadenza.operators import models as MO
from cadenza.operators import sampling as S
from cadenza.operators import svm as SV
from cadenza.sources import sinks as SK
from pyspark.sql import functions as F

SCHEMA = "doc_id long, label string, split string, is_train boolean, text string"


def _docs(spark, odd=False):
    rng = np.random.default_rng(3)
    words = {"a": ["ape", "ant", "axe"], "b": ["bee", "bat", "bus"], "c": ["cat", "cow", "cup"]}
    rows = []
    for i in range(90):
        label, split = "abc"[i % 3], "train" if i % 5 else "test"
        text = " ".join([*rng.choice(words[label], 3), "the", "the", f"own{i % 40}"]) if i % 11 else ["", None][i % 2]
        rows.append((i, label, split, split == "train", text))
    if odd:
        rows += [rows[1], rows[1], (3, "b", "train", True, "bee the"), (None, "a", "train", True, "ape nowhere"),
                 (None, "a", "train", True, "ant the"), (200, None, "train", True, "the odd"), (201, None, "test", False, "never seen")]
    return spark.createDataFrame(rows, SCHEMA)


def _long(d):
    """(doc_id, label, split, is_train, term, tfidf) by the operators on rows."""
    keep, n = ["label", "split", "is_train"], d.where("split = 'train'").agg(F.count(F.lit(1)).alias("n"))
    counts = FE.term_counts(d, keep=keep)
    return FE.tfidf(counts, FE.fit_idf(counts.where("split = 'train'"), n), keep)


def _values(item):
    _, k = item
    unit = BL.unit_of(k)
    keys, terms = k["keys"].to_pylist(), k["terms"].to_pylist()
    label = k["label"].to_pylist()
    return [(keys[u], label[u], terms[a], round(float(x), 9)) for u, a, x in zip(unit, k["at"], BL.values_of(k, unit)) if x]


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("entries,terms", [(1 << 20, 1 << 20), (40, 16)])
def test_blocks_hold_the_features_of_the_rows(spark, monkeypatch, odd, entries, terms):
    """also where rows share a key or lack one, and whatever the sizes of the blocks are"""
    monkeypatch.setattr(BL, "TERMS", terms)
    monkeypatch.setattr(FE, "pack_words", lambda d, w: BL.pack_words(d, w, entries))
    monkeypatch.setattr(FE, "pack_rows", lambda d, v: BL.pack_rows(d, v, entries))
    many = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(many, 4 if entries == 40 else 10_000)
    d = _docs(spark, odd)
    blocks = FE.block_tfidf(d, d.where("split = 'train'").count())
    spark.conf.unset(many)
    want = sorted((r["doc_id"], r["label"], r["term"], round(r["tfidf"], 9)) for r in _long(d).collect() if r["doc_id"] is not None)
    assert sorted(x for x in blocks.rows.flatMap(_values).collect() if x[0] is not None) == want
    again = BL.Blocks(blocks.stored())
    assert sorted(x for x in again.rows.flatMap(_values).collect() if x[0] is not None) == want
    assert again.n == blocks.n and (blocks.n > 4 and blocks.q > 1) == (entries == 40)
    blocks.release()
    again.release()


@pytest.mark.parametrize("odd", [False, True])
def test_models_are_the_same_over_blocks_and_rows(spark, monkeypatch, odd):
    """F5, F7, F15"""
    d, scored = _docs(spark, odd), {}
    train, docs = d.where("split = 'train'").select("doc_id", "label"), d.select("doc_id", "label")
    for small in (False, True):
        if small:
            monkeypatch.setattr(BL, "TERMS", 16)
            monkeypatch.setattr(FE, "pack_words", lambda d, w: BL.pack_words(d, w, 40))
        blocks = FE.block_tfidf(d, train.count(), part=SV.batch_of("doc_id", 4, 42), parts=4) if small else _long(d)
        weights = SV.fit(blocks, train, passes=2)
        w = {(r["class"], r["term"]): r["w"] for r in weights.collect()}
        p = sorted(map(str, SV.predict(blocks, docs, weights).collect()))
        s = {(r["doc_id"], r["class"]): r["score"] for r in MO.naive_bayes(blocks, train, docs).collect()}
        scored[small] = w, p, s
    (w, p, s), (w2, p2, s2) = scored[False], scored[True]
    assert p == p2 and s.keys() == s2.keys() and all(s2[k] == pytest.approx(x, abs=1e-9) for k, x in s.items())
    assert all(w2.get(k, 0) == pytest.approx(x, abs=1e-9) for k, x in w.items())


def test_steps_store_no_weights_and_shuffle_no_features(spark, monkeypatch):
    """every step used to write all weights twice and to shuffle the batch's features"""
    stored, real = [], SV.materialise
    monkeypatch.setattr(SV, "materialise", lambda df, name, **more: (stored.append(name), real(df, name, **more))[1])
    d = _docs(spark)
    SV.fit(_long(d), d.where("is_train").select("doc_id", "label"), passes=2)
    assert stored == ["svm-docs", "svm-weights"]


def test_run_stores_features_in_blocks_and_joins_no_ids(spark, tmp_path):
    """F5"""
    from cadenza.plans.classify import RunOptions, run_classification

    rows = [(f"k{i}", "s", f"t{i}", 1, 1, 6, f"f{i}", "ab"[i % 3 == 0], 1, f"{'ape' if i % 3 else 'bee'} the\nrow own{i}") for i in range(40)]
    lab = spark.createDataFrame(rows, "msd_id string, msd_artist string, msd_title string, is_english int, lyrics_available int, wordcount int, "
                                      "lyrics_filename string, mood string, matched_mood int, lyrics string")
    got = {r["split"]: (r["n"], r["n_vectorised"]) for r in run_classification(spark, lab, RunOptions(vocab_size=50), "t", root=str(tmp_path)).collect()}
    assert got["dev"] == got["test"] == (4, 4) and got["train"][0] == got["train"][1] >= 32
    stage = {p.name.rsplit("-", 1)[0]: next(v for v in p.iterdir() if v.name.startswith("v-")) for p in tmp_path.iterdir() if p.name != "step_log"}
    assert {"block", "doc_id", "at", "idf", "norm"} <= set(spark.read.parquet(str(stage["features"])).columns)
    vec = spark.read.parquet(str(stage["vectorised"]))
    assert vec.columns == ["doc_id", "split", "mood_cats", "ids"] and vec.count() == sum(n for n, _ in got.values())


def test_texts_are_dealt_by_their_own_bytes(spark, tmp_path, monkeypatch):
    """Files may hold far fewer bytes than their texts"""
    spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same words " * 100).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    monkeypatch.setattr(SK, "DEAL_TEXT", 11_000)
    assert SK.input_bytes(d) < 100_000 and SK.deal(d, "doc_id", "text").rdd.getNumPartitions() == 30


def test_class_codes_shuffle_no_rows(spark):
    """texts dealt by their class landed in as many tasks as there are classes"""
    d = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None) for i in range(40)], "doc_id long, lang string")
    coded = S.class_codes(d, "lang", "code")
    assert "BroadcastHashJoin" in coded._jdf.queryExecution().executedPlan().toString()
    assert {(r["lang"], r["code"]) for r in coded.collect()} == {("a", 0), ("b", 1), ("c", 2), (None, -1)}
