"""No limits on ids, positions and orders; metrics without a class; the published text definitions; naive Bayes by hand."""

import math

from pyspark.sql import functions as F

from cadenza.functions import text as TX
from cadenza.operators import metrics as ME
from cadenza.operators import models as MO
from cadenza.operators import tags as T
from cadenza.operators import vectors as VE
from cadenza.operators import vocab as V
from cadenza.operators.lexicon import Lexicon
from cadenza.sources.tables import TagStore


def test_vocabulary_with_any_id(spark):
    """Ties go to the first appearance for huge and negative ids and positions."""
    rows = [(1 << 62, 0, "late"), (-(1 << 62), (1 << 31) - 1, "first"), (1 << 40, 5, "mid"), (1 << 40, 4, "before"),
            (7, 0, "twice"), (8, 0, "twice")]
    got = V.vocabulary(spark.createDataFrame(rows, "doc_id long, pos int, word string"), 10).orderBy("word_id").collect()
    assert [r["word"] for r in got] == ["UNK", "twice", "first", "before", "mid", "late"]


def test_first_tag_with_any_order_and_many_moods(spark):
    lex = Lexicon(exact={f"m{i}": [f"t{i}"] for i in range(80)})
    store = TagStore(spark.createDataFrame([(1, "1"), (2, "2")], "tid_id long, tid string"),
                     spark.createDataFrame([(i, f"t{i}") for i in range(80)], "tag_id long, tag string"),
                     spark.createDataFrame([(1, 79, 1.0, 1 << 60), (1, 3, 1.0, (1 << 60) + 1), (2, 70, 1.0, -5)],
                                           "tid_id long, tag_id long, val double, tag_ord long"))
    assert {r["tid_id"]: r["mood"] for r in T.label_exact(store, lex).collect()} == {1: "m79", 2: "m70"}


def test_metrics_without_a_class(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("never_predicted", "a"), ("b", "never_true")],
                                  "label string, prediction string")
    cm = ME.confusion_long(pairs)
    got = {r["cls"]: r for r in ME.per_class_scores(cm).collect()}
    assert got["never_predicted"]["precision"] is None and got["never_predicted"]["recall"] == 0
    assert got["never_true"]["recall"] is None and got["never_true"]["f1"] is None
    assert got["b"]["f1"] == 0 and got["a"]["precision"] == 0.5
    report = {r["cls"]: r["pct"] for r in ME.per_class_report(cm).collect()}
    assert report["never_true"] is None and report["TOTAL"] == 25
    runs = cm.withColumn("run", F.lit("x")).unionByName(
        ME.confusion_long(pairs.where("label = 'a'")).withColumn("run", F.lit("y")))
    f1 = {r["cls"]: r for r in ME.f1_by_run(runs, ["x", "y"]).collect()}
    assert f1["never_true"]["x"] == -1 and f1["never_true"]["y"] == -1 and f1["a"]["y"] > 0


def test_zero_vectors_and_documents_without_tokens(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = VE.nearest_k(v, v, "vec_id", "embedding", 2).collect()
    assert {(r["probe_id"], r["neighbour_id"]) for r in got} == {(1, 2), (2, 1)}
    docs = spark.createDataFrame([(1, ["x", "x", "y"]), (2, []), (3, ["zzz"])], "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([(0, "UNK", 0), (1, "x", 2), (2, "y", 1)], "word_id int, word string, n long")
    ids = {r["doc_id"]: r["ids"] for r in V.encode_docs(docs, F.col("tokens"), vocab).collect()}
    assert ids == {1: [1, 1, 2], 2: [], 3: [0]}
    stream = V.encode_stream(V.token_stream(docs, F.col("tokens"), keep_empty=True), vocab)
    pooled = {r["doc_id"]: (r["n_hits"], r["e0"]) for r in VE.mean_pool(
        stream, v.where("vec_id > 0"), "vec_id", "embedding", 2).collect()}
    assert pooled == {1: (3, 1.0), 2: (0, None), 3: (0, None)}


def test_blanks_are_those_of_split(spark):
    text = "a b c　d\te\x0bf\x1cg\x85h i  j"
    row = spark.createDataFrame([(text,)], "t string").select(
        TX.word_count(F.col("t")).alias("n"), TX.whitespace_tokens(F.col("t")).alias("w"),
        TX.wordpunct_tokens(F.col("t")).alias("p"), TX.treebank_tokens(F.col("t")).alias("b")).first()
    assert row["n"] == len(text.split()) == 10
    assert row["w"] == row["p"] == row["b"] == text.split()


def test_contraction_forms(spark):
    lines = {"'tis a pity": ["'t", "is", "a", "pity"], "'twas more'n that": ["'t", "was", "more", "'n", "that"],
             "d'ye see": ["d", "'ye", "see"], "gimme cannot wanna gotta": ["gim", "me", "can", "not", "wan", "na", "got", "ta"]}
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    assert {r["t"]: r["b"] for r in df.select("t", TX.treebank_tokens(F.col("t")).alias("b")).collect()} == lines


def test_own_tokeniser(spark):
    df = spark.createDataFrame([("One-two THREE",)], "t string")
    got = df.select(TX.preprocess(F.col("t"), lambda c: F.split(c, "[- ]"), False, False).alias("w")).first()["w"]
    assert got == ["one", "two", "three"]


def test_naive_bayes_by_hand(spark):
    feats = spark.createDataFrame([(1, "x", 1.0, "a", True), (2, "y", 1.0, "b", True), (3, "x", 0.6, None, False),
                                   (3, "new", 0.8, None, False)], "doc_id long, term string, tfidf double, label string, is_train boolean")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b")], "doc_id long, label string")
    scores = MO.naive_bayes(feats.where("term <> 'new'"), docs.where("doc_id < 3"), docs)
    got = {(r["doc_id"], r["class"]): r["score"] for r in scores.collect()}
    half, seen, unseen = math.log(0.5), math.log(2 / 3), math.log(1 / 3)
    want = {(1, "a"): half + seen, (1, "b"): half + unseen, (2, "a"): half + unseen, (2, "b"): half + seen,
            (3, "a"): half + 0.6 * seen, (3, "b"): half + 0.6 * unseen, (4, "a"): half, (4, "b"): half}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {r["doc_id"]: r["predicted"] for r in MO.best_class(scores).collect()} == {1: "a", 2: "b", 3: "a", 4: "a"}
    loss = {r["doc_id"]: r["loss"] for r in MO.log_loss(scores, docs).collect()}
    assert abs(loss[4] - math.log(2)) < 1e-9 and abs(loss[1] - math.log(1.5)) < 1e-9


def test_window_features_follow_their_sizes(spark):
    docs = spark.createDataFrame([(1, ["p", "q", "r"]), (2, ["q"]), (3, [])], "doc_id long, tokens array<string>")
    vecs = spark.createDataFrame([("p", [1.0]), ("q", [3.0]), ("UNK", [-1.0])], "word string, vec array<double>")

    def features(sizes):
        return {r["doc_id"]: [round(x, 6) for x in r["features"].toArray()]
                for r in MO.window_features(docs, "tokens", vecs, 1, sizes).collect()}

    assert features((2, 3)) == {1: [2.0, 1.0], 2: [3.0, 3.0], 3: [0.0, 0.0]}
    assert features((1,)) == {1: [3.0], 2: [3.0], 3: [0.0]}
