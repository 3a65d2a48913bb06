"""SVM, word vectors, convolutional classifier, term index, resume filter, frame fingerprints, stages and streams."""

import random
import threading
import time
from collections import Counter

import numpy as np
import pytest
from cadenza import session
from cadenza.operators import embeddings as EM
from cadenza.operators import frames as FR
from cadenza.operators import langid as LI
from cadenza.operators import pairs as PA
from cadenza.operators import projection as PR
from cadenza.operators import svm as SV
from cadenza.operators import tags as TG
from cadenza.operators import textcnn as CN
from cadenza.operators import vectors as VE
from cadenza.operators import vocab as V
from cadenza.operators.lexicon import Lexicon
from cadenza.operators.sampling import hash_key
from cadenza.plans.index import corpus_stats, index_songs, may_hold, name_filter
from cadenza.sources import sinks as SK
from cadenza.sources.files import parse_sep_lines
from cadenza.streaming.incremental import running_scoreboard
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# M4


def _features(rng, n, noise=0.3):
    """Documents of three classes whose terms overlap; one term is in every document."""
    own = {"a": "fox dog cat".split(), "b": "car bus van".split(), "c": "sun sky sea".split()}
    rows, docs = [], []
    for i in range(n):
        label = "aabc"[i % 4]
        words = {"the": 1.0} | {rng.choice(own[label]): 1.0 for _ in range(2)}
        if rng.random() < noise:
            words[rng.choice(own[rng.choice("abc")])] = 1.0
        norm = len(words) ** 0.5
        rows += [(i, w, 1 / norm) for w in words]
        docs.append((i, label))
    return rows, docs


def _numpy_svm(rows, docs, part, penalty, passes, parts):
    terms, classes = sorted({t for _, t, _ in rows}), sorted({c for _, c in docs})
    x = np.zeros((len(docs), len(terms) + 1))
    x[:, -1] = 1
    for i, t, v in rows:
        x[i, terms.index(t)] = v
    y = np.where(np.array([c for _, c in docs])[:, None] == np.array(classes), 1.0, -1.0)
    w = np.zeros((len(classes), x.shape[1]))
    for t in range(1, passes * parts + 1):
        now = part == (t - 1) % parts
        inside = (y[now] * (x[now] @ w.T) < 1) * y[now]
        rate = min(5 / t ** 0.5, 1 / penalty)
        w = (1 - penalty * rate) * w + rate * inside.T @ x[now] / now.sum()
        w *= np.minimum(1, penalty ** -0.5 / np.linalg.norm(w, axis=1))[:, None]
    return {(c, t): w[i, j] for i, c in enumerate(classes) for j, t in enumerate([*terms, None])}


def test_svm_steps_are_the_formula_and_predict_well(spark):
    rows, docs = _features(random.Random(1), 200)
    x, d = spark.createDataFrame(rows, "doc_id long, term string, tfidf double"), spark.createDataFrame(docs, "doc_id long, label string")
    extra = d.union(spark.createDataFrame([(500, None)], d.schema))  # a document without a label teaches nothing
    got = {(r["class"], r["term"]): r["w"] for r in SV.fit(x, extra, penalty=1e-2, passes=3, parts=4).collect()}
    part = {r["doc_id"]: r["p"] for r in d.select("doc_id", SV.batch_of("doc_id", 4, 42).alias("p")).collect()}
    want = _numpy_svm(rows, docs, np.array([part[i] for i in range(200)]), 1e-2, 3, 4)
    assert all(got.get(k, 0) == pytest.approx(v, abs=1e-8) for k, v in want.items())
    again = {(r["class"], r["term"]): r["w"] for r in
             SV.fit(x.repartition(7, "term"), d.repartition(3), penalty=1e-2, passes=3, parts=4).collect()}
    assert all(again[k] == pytest.approx(v, abs=1e-8) for k, v in got.items())
    weights = SV.fit(x, d)
    none = spark.createDataFrame([(900, "a")], d.schema)  # no features: the biases decide
    out = SV.predict(x, d.union(none), weights).collect()
    assert len(out) == 201 and np.mean([r["label"] == r["predicted"] for r in out]) > 0.9


def test_svm_batches_are_the_hash_of_the_key(spark):
    d = spark.range(50).withColumnRenamed("id", "doc_id")
    got = d.select(SV.batch_of("doc_id", 4, 42).alias("p"), hash_key(42, F.col("doc_id")).alias("h")).collect()
    assert all(r["p"] == int(r["h"][:8], 16) % 4 for r in got)


# M5


def _corpus(rng, n):
    """Short sentences of four kinds between filler; the words of a pair take each other's place."""
    kinds = [("lorry|truck", "drives", "road"), ("apple|pear", "grows", "tree"), ("king|queen", "rules", "castle"), ("ship|boat", "sails", "sea")]
    out = []
    for i in range(n):
        said = [rng.choice(w.split("|")) for w in kinds[i % 4]]
        out.append([f"x{rng.randint(0, 30)}" for _ in range(4)] + said + [f"x{rng.randint(0, 30)}" for _ in range(4)])
    return out


def _vectors(spark, sentences, partitions, **options):
    words = [w for w, _ in Counter(w for s in sentences for w in s).most_common()]
    count = Counter(w for s in sentences for w in s)
    vocab = spark.createDataFrame([(0, "UNK", 0)] + [(i + 1, w, count[w]) for i, w in enumerate(words)],
                                  "word_id int, word string, n long")
    ids = {w: i + 1 for i, w in enumerate(words)}
    docs = spark.createDataFrame([(i, [ids[w] for w in s]) for i, s in enumerate(sentences)], "doc_id long, ids array<int>")
    pairs = EM.id_pairs(docs.repartition(partitions), F.col("ids"), 4)
    return {r["word"]: np.array(r["vec"]) for r in EM.fit(pairs, vocab, dim=16, **options).collect()}


def test_planted_synonyms_are_nearest_and_partitions_do_not_matter(spark):
    sentences = _corpus(random.Random(7), 1600)
    got = _vectors(spark, sentences, 3, blocks=3, passes=6)
    for pair in (("lorry", "truck"), ("apple", "pear"), ("king", "queen"), ("ship", "boat")):
        for a, b in (pair, pair[::-1]):
            assert max((u for u in got if u not in (a, "UNK")), key=lambda u: got[a] @ got[u]) == b
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in got.values())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        again = _vectors(spark, sentences, 5, blocks=3, passes=6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(np.array_equal(got[w], again[w]) for w in got)
    assert got.keys() == again.keys() == {"UNK"} | {w for s in sentences for w in s}


def test_a_pass_lowers_the_loss():
    draw = np.random.default_rng(0)
    u, v = draw.normal(0, 0.1, (20, 8)).astype(np.float32), np.zeros((20, 8), np.float32)
    gu, gv = np.zeros(20), np.zeros(20)
    c, o = np.divmod(np.arange(400), 20)
    n = np.where(c % 4 == o % 4, 50, 1)
    losses = [EM.train_cell(u, v, gu, gv, np.arange(1, 21) / 20, c, o, n, np.random.default_rng(i)) for i in range(8)]
    assert losses[-1] < 0.8 * losses[0]


# M6


def _texts(spark, n):
    """Class by the order of two words, which no bag of words can tell."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        ids = [rng.randint(3, 19) for _ in range(14)]
        at, label = rng.randint(0, 11), "yes" if i % 2 else "no"
        ids[at: at + 2] = [1, 2] if label == "yes" else [2, 1]
        rows.append((i, ids, label))
    return spark.createDataFrame(rows, "doc_id long, ids array<int>, label string")


def test_convolutions_learn_word_order_and_drop_out_counts(spark):
    words = np.random.default_rng(0).normal(0, 1, (20, 8))
    docs = _texts(spark, 400)
    train, held = docs.where("doc_id < 320"), docs.where("doc_id >= 320")
    net, log = CN.fit(train, words, ["no", "yes"], filters=8, dropout=0.2, passes=10, batches=4)
    loss = [np.mean([x for s, x, _ in log if s // 4 == e]) for e in range(10)]
    assert loss[-1] < 0.5 * loss[0]
    got = {r["doc_id"]: r["predicted"] for r in CN.predict(net, held).collect()}
    assert np.mean([got[r["doc_id"]] == r["label"] for r in held.collect()]) > 0.8  # the larger class has one half
    other, _ = CN.fit(train, words, ["no", "yes"], filters=8, dropout=0.0, passes=1, batches=4)
    same, _ = CN.fit(train.repartition(5), words, ["no", "yes"], filters=8, dropout=0.0, passes=1, batches=4)
    dropped, _ = CN.fit(train, words, ["no", "yes"], filters=8, dropout=0.5, passes=1, batches=4)
    assert np.allclose(other.params["w"], same.params["w"], atol=1e-8)
    assert not np.allclose(other.params["w"], dropped.params["w"], atol=1e-3)
    back = CN.from_table(CN.to_table(spark, net))
    assert back.labels == net.labels and all(np.allclose(back.params[k], net.params[k]) for k in net.params)
    assert list(back.params) == list(net.params)


def test_gradient_is_the_slope():
    draw = np.random.default_rng(1)
    net = CN.Network.begin(draw.normal(0, 1, (9, 4)), ["a", "b", "c"], (3, 4), 3, 5)
    ids, y = draw.integers(0, 9, (6, 7)), draw.integers(0, 3, 6)
    keep = CN.keep_mask(list(range(6)), 1, 2, 6, 0.3)
    _, grad = net.gradient(ids, y, keep)
    flat, slope = net.flat(net.params), net.flat(grad)
    for i in range(0, len(flat), 5):
        ends = []
        for h in (1e-6, -1e-6):
            moved = flat.copy()
            moved[i] += h
            net.params = net.shaped(moved)
            ends.append(net.gradient(ids, y, keep)[0])
        assert slope[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-4)


# M10


def _kept(x, y, k=5):
    """Share of each point's k nearest vectors that are among its k nearest positions."""
    near = [np.argsort(((a - a[:, None]) ** 2).sum(axis=2) + np.eye(len(a)) * 1e9, axis=1)[:, :k] for a in (x, y)]
    return np.mean([len(set(p) & set(q)) / k for p, q in zip(*near)])


def test_neighbour_embedding_keeps_neighbours_better_than_axes(spark):
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(0, 3, (1, 24)) + draw.normal(0, 1, (6, 24)) for _ in range(20)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (900, [0.0] * 24)]
    df = spark.createDataFrame(rows, "w long, v array<double>")
    out = PR.neighbour_embedding(df, "w", "v", limit=120, perplexity=6)
    got = np.array([[r["x"], r["y"]] for r in out.orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    axes = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert got.shape == (120, 2) and np.isfinite(got).all()
    assert _kept(x, got) > _kept(x, axes) + 0.15
    assert PR.neighbour_embedding(df.limit(0), "w", "v").collect() == []
    p = PR.bandwidth(np.sort(draw.random(60)), 10)
    assert np.exp(-(p * np.log(p)).sum()) == pytest.approx(10, rel=1e-3)


# W3


def test_frequent_vocabulary_is_the_vocabulary_whatever_the_sketch(spark):
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)]
    stream = spark.createDataFrame([(i // 40, i % 40, w) for i, w in enumerate(words)], "doc_id long, pos int, word string")
    for size, columns in ((50, 1 << 12), (50, 16), (5000, 1 << 12), (1, 64)):
        want = sorted(tuple(r) for r in V.vocabulary(stream, size).collect())
        assert sorted(tuple(r) for r in V.frequent_vocabulary(stream, size, columns).collect()) == want
    few = V.count_sketch(stream.groupBy("word").count().toDF("word", "n"), 16)
    assert few.count() <= 16 * V.SKETCH_ROWS


# J9, M9


def test_encoding_of_odd_token_arrays(spark):
    vocab = spark.createDataFrame([(0, "UNK", 1), (1, "the", 5), (2, "\u00e9a", 2)], "word_id int, word string, n long")
    rows = [(1, ["the", "x", "\u00e9a", "the"]), (2, []), (3, None), (4, ["UNK"]), (None, ["the"]), (1, ["the"])]
    docs = spark.createDataFrame(rows, "doc_id long, t array<string>")
    want = sorted([(1, [1, 0, 2, 1]), (2, []), (3, []), (4, [0]), (None, [1]), (1, [1])], key=repr)
    for d in (docs, docs.coalesce(1), docs.where("doc_id > 1 OR doc_id IS NULL").union(docs.where("doc_id = 1"))):
        assert sorted((tuple(r) for r in V.encode_docs(d, F.col("t"), vocab).collect()), key=repr) == want
    assert "Exchange" not in plan_of(V.encode_docs(docs, F.col("t"), vocab))


def test_batches_count_as_rows_do(spark):
    """Vocabulary, pairs and pooled vectors by Arrow batch against the forms with a row for each token."""
    rng = random.Random(8)
    rows = [(rng.choice([None, -3, 2 ** 40, *range(30)]), [rng.choice("the the the a b c d \u00e9 <PAD>".split()) for _ in range(rng.choice([0, 1, 2, 9]))])
            for _ in range(120)] + [(77, None), (78, [])]
    for df in (spark.createDataFrame(rows, "doc_id long, t array<string>"),
               spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, t array<string>")):
        docs = df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3)
        docs = SK.materialise(docs, "odd")
        want = sorted(tuple(r) for r in V.vocabulary(V.token_stream(docs, F.col("t")), 4).collect())
        assert sorted(tuple(r) for r in V.vocabulary(V.batch_counts(docs, F.col("t")), 4).collect()) == want
        for window in (1, 3):
            pairs = PA.pair_counts(PA.skipgram_pairs(docs, F.col("t"), window)).collect()
            assert {tuple(r) for r in PA.counted_pairs(docs, F.col("t"), window).collect()} == {tuple(r) for r in pairs}
    assert V.batch_counts(df.limit(0), F.col("t")).collect() == [] == PA.counted_pairs(df.limit(0), F.col("t")).collect()
    ids = spark.createDataFrame([(1, [0, 1, 1, 9]), (2, []), (3, None), (4, [7]), (5, [2, 2])], "doc_id long, ids array<int>")
    vecs = spark.createDataFrame([(0, [1.0, 2.0]), (1, [4.0, -1.0]), (2, [0.5, 0.5]), (3, None), (900, [9.0, 9.0])], "i long, v array<double>")
    for some in (ids, ids.where("doc_id > 1").coalesce(1)):
        got = {r["doc_id"]: (r["n_hits"], r["e"]) for r in VE.pool_ids(some, F.col("ids"), vecs, "i", "v", 2, 5).collect()}
        want = {1: (3, [3.0, 0.0]), 2: (0, None), 3: (0, None), 4: (0, None), 5: (2, [0.5, 0.5])}
        assert got == {k: v for k, v in want.items() if k in got} and len(got) == some.count()


def test_any_number_of_languages(spark, monkeypatch):
    rng = random.Random(6)
    say = {f"l{k:02}": "".join(random.Random(k).choice("abcdefgh") for _ in range(8)) for k in range(7)}
    rows = [(i, "".join(rng.choice(say[f"l{i % 7:02}"]) for _ in range(30)), f"l{i % 7:02}" if i % 3 else None) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train_lang string")
    langs = LI.languages(docs, "train_lang")
    whole = {tuple(r) for r in LI.fit_and_score(docs, langs).collect()}
    monkeypatch.setattr(LI, "COLUMNS", 2)
    assert {tuple(r) for r in LI.fit_and_score(docs, langs).collect()} == whole and len(langs) == 7
    assert LI.fit_and_score(docs, []).collect() == []


# J5 to J7


def test_ten_thousand_terms_without_a_nested_loop(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    lex = Lexicon({"m": [], "n": []}, {"m": [word() for _ in range(5000)] + ["", "aa"], "n": [word() for _ in range(5000)]},
                  {"m": [word() for _ in range(50)], "n": ["b"]})
    texts = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14))) for _ in range(120)} | {"aaaa", "", "ab"})
    df = spark.createDataFrame([(t,) for t in texts], "tag string")
    out = TG.tag_text_deltas(df, lex)
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    want = {}
    for t in texts:
        for m in "mn":
            likes = sum(x in t for x in lex.like[m])
            if likes:
                want[t, m] = (likes, likes * (1 - sum(t.count(x) for x in lex.filters[m])))
    assert {(r["tag"], r["mood"]): (r["n_like"], r["delta"]) for r in out.collect()} == want


def test_patterns_in_a_lexicon_still_match_as_patterns(spark):
    lex = Lexicon({"m": []}, {"m": ["^a.c", "x+"]}, {"m": []})
    df = spark.createDataFrame([("abc",), ("zabc",), ("xx",)], "tag string")
    assert {r["tag"] for r in TG.tag_text_deltas(df, lex).collect()} == {"abc", "xx"}


# P5, L1


def test_resume_looks_only_at_texts_that_are_wanted(spark):
    corpus = spark.createDataFrame([(f"f{i}", f"some words {i}", "en") for i in range(2000)], "lyrics_filename string, lyrics string, lang string")
    names = spark.createDataFrame([(f"f{i}",) for i in range(0, 2000, 200)] + [(None,), ("absent",)], "fn string")
    kept = {r[0] for r in may_hold(corpus, "lyrics_filename", name_filter(names, "fn")).select("lyrics_filename").collect()}
    assert {f"f{i}" for i in range(0, 2000, 200)} <= kept and len(kept) < 15
    tight = {r[0] for r in may_hold(corpus, "lyrics_filename", name_filter(names, "fn", 32768), 32768).collect()}
    assert {f"f{i}" for i in range(0, 2000, 200)} <= tight
    songs = spark.createDataFrame(
        [(str(i), "a", f"t{i}", 1, 1 if i % 10 else -1, 7, "old") for i in range(50)] + [("x", None, None, 0, None, 3, "null")],
        "msd_id string, msd_artist string, msd_title string, is_english int, lyrics_available int, wordcount int, lyrics_filename string")
    out = index_songs(songs, corpus)
    plan = plan_of(out)
    words = plan.index("n_words")
    assert "bitmap_construct_agg" in plan and plan.index("getbit", words) > words  # counted above the probe
    rows = {r["msd_id"]: r for r in out.collect()}
    assert len(rows) == 51 and all(rows[str(i)]["wordcount"] == 7 for i in range(50) if i % 10)
    assert all(rows[str(i)]["lyrics_available"] == 0 for i in range(0, 50, 10))
    assert rows["x"]["lyrics_available"] is None and rows["x"]["wordcount"] == 3
    assert corpus_stats(corpus).count() == 2000


# U4


def test_frames_differ_where_they_do(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (2, None, 0.0), (None, "y", float("nan"))], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "", -0.0), (None, "y", float("nan")), (9, "n", None)], "k long, s string, v double")
    assert tuple(FR.frames_equal(a, b).first()) == (2, 2)
    assert tuple(FR.frames_equal(a, a.repartition(3)).first()) == (0, 0)
    assert tuple(FR.frames_equal(a, a.limit(0)).first()) == (4, 0)
    assert FR.differing_leaves(a, a.orderBy("k")).collect() == []


def test_equal_frames_are_read_once(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "cast(id % 7 as string) s").write.parquet(str(tmp_path / "t"))
    one = lambda: spark.read.parquet(str(tmp_path / "t"))
    same = FR.frames_equal(one(), one().repartition(4))
    assert tuple(same.first()) == (0, 0)
    final = same._jdf.queryExecution()
    rows = same.collect()
    assert tuple(rows[0]) == (0, 0) and final is not None


# S15, scratch folders


def test_concurrent_builders_never_mix(spark, tmp_path):
    seen, errors = [], []

    def build(k):
        def rows():
            time.sleep(0.05 * k)
            return spark.range(1000).selectExpr(f"{k} AS k", "id")
        return rows

    def run(k):
        try:
            df = SK.stage(spark, "s", {"p": 1}, build(k), reuse=False, root=str(tmp_path))
            seen.append((k, {tuple(r) for r in df.groupBy("k").count().collect()}))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in (1, 2, 3)]
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):  # a reader sees nothing or one whole version
        whole = SK.stage(spark, "s", {"p": 1}, build(0), root=str(tmp_path))
        assert [r["count"] for r in whole.groupBy("k").count().collect()] == [1000]
    for t in threads:
        t.join()
    assert not errors and all(got == {(k, 1000)} for k, got in seen)
    last = SK.stage(spark, "s", {"p": 1}, build(9), root=str(tmp_path))
    assert last.select("k").distinct().first()[0] in (0, 1, 2, 3)


def test_replaced_versions_go(spark, tmp_path):
    for k in (1, 2):
        SK.stage(spark, "s", {}, lambda k=k: spark.range(k), reuse=False, root=str(tmp_path), keep_s=-5)
    folder = next(tmp_path.iterdir())
    assert len([p for p in folder.iterdir() if p.name.startswith("v-")]) == 1
    assert SK.stage(spark, "s", {}, lambda: spark.range(9), root=str(tmp_path)).count() == 2


def test_a_crashed_build_publishes_nothing(spark, tmp_path):
    def fail():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        SK.stage(spark, "s", {}, fail, root=str(tmp_path))
    assert SK.stage(spark, "s", {}, lambda: spark.range(3), root=str(tmp_path)).count() == 3


def test_scratch_is_cleared_and_swept(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(session, "_TABLES", f"tables-{tmp_path.name}")
    mine = session.app_scratch(spark)
    df = SK.materialise(spark.range(5), "x")
    assert os.path.isdir(mine) and df.count() == 5
    other = f"{os.path.dirname(mine)}/app-gone"
    spark.range(1).write.parquet(other + "/t")
    assert session.sweep_scratch(spark, 3600) == [] and session.sweep_scratch(spark, -5) == ["app-gone"]
    session.clear_scratch(spark)
    assert not os.path.exists(mine) and not os.path.exists(other)


# R2


def test_scoreboard_goes_on_after_a_restart(spark, tmp_path):
    lex = Lexicon({"sad": [], "happy": []}, {"sad": ["sad"], "happy": ["joy"]}, {"sad": [], "happy": []})
    tags = spark.createDataFrame([(1, "so sad"), (2, "joy"), (3, "plain"), (4, "sad joy")], "tag_id long, tag string")
    tids = spark.createDataFrame([(i,) for i in range(6)], "tid_id long")
    rows = [(i % 7, 1 + (i * 5) % 4, 1.0) for i in range(90)]
    done = []
    for k in range(3):
        part = rows[30 * k: 30 * k + 30]
        spark.createDataFrame(part, "tid_id long, tag_id long, val double").coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        done += part
        got = running_scoreboard(spark, str(tmp_path / "in"), tags, tids, lex, str(tmp_path / "ckpt"), files_per_batch=1)
        want = Counter()
        for song, tag, _ in done:
            for mood, hit in (("sad", (1, 4)), ("happy", (2, 4))):
                if song < 6 and tag in hit:
                    want[song, mood] += 1
        found = [(r["tid_id"], r["mood"], r["score"]) for r in got.collect()]
        assert {(a, b): c for a, b, c in found} == want and len(found) == len(want)
    again = running_scoreboard(spark, str(tmp_path / "in"), tags, tids, lex, str(tmp_path / "ckpt"))
    assert {(r["tid_id"], r["mood"]): r["score"] for r in again.collect()} == want


# S4


def test_mapping_lines_are_stripped_of_tabs(spark):
    ok, bad = parse_sep_lines(spark.createDataFrame([("\t a<SEP>b<SEP>c<SEP>d<SEP>e<SEP>f \t\r",), ("# no",), ("x<SEP>y \t",)], "value string"))
    assert [tuple(r) for r in ok.collect()] == [tuple("abcdef")]
    assert [tuple(r) for r in bad.collect()] == [("x<SEP>y", 2)]


# L8


def test_staged_run_trains_filters_and_logs_every_step(spark, tmp_path):
    from cadenza.plans.classify import RunOptions, run_classification
    from cadenza.sources.songs import labelled_documents

    lab = labelled_documents(spark, "/root/testdata/sf0.001")
    opts = dict(vocab_size=500, model="cnn", embedding_size=8, num_filters=6, num_epochs=4, balance=False, filter_sizes=(2, 3))
    got = {}
    for rate in (0.0, 0.5):
        root = str(tmp_path / f"run{rate}")
        for _ in range(2):  # the second time everything is read again
            rows = run_classification(spark, lab, RunOptions(dropout=rate, **opts), "t", root=root).collect()
        got[rate] = {r["split"]: (r["n"], r["accuracy"]) for r in rows}
        log = spark.read.parquet(f"{root}/step_log").where("dataset = 'train' AND loss IS NOT NULL").orderBy("step").collect()
        assert len(log) == 4 * 8  # trained once
        assert np.mean([r["loss"] for r in log[-8:]]) < np.mean([r["loss"] for r in log[:8]])
        got[rate, "loss"] = [r["loss"] for r in log]
    assert got[0.0, "loss"] != got[0.5, "loss"]
    counts = Counter(r["mood"] for r in lab.select("mood").collect())
    assert sum(n for n, _ in got[0.0].values()) == sum(counts.values())
    assert got[0.0]["train"][1] > max(counts.values()) / sum(counts.values())
    svm = run_classification(spark, lab, RunOptions(vocab_size=500, model="svm", balance=False, l2_reg_lambda=1e-3), "t",
                             root=str(tmp_path / "svm")).collect()
    assert all(r["accuracy"] > 0.9 for r in svm)
    with pytest.raises(ValueError):
        run_classification(spark, lab, RunOptions(vocab_size=500, model="none", balance=False), "t", root=str(tmp_path / "none"))
