"""Golden values from the reference's own tests and sample data."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as TX
from cadenza.functions.formatting import percent_text, run_key
from cadenza.operators import frames as FR
from cadenza.operators import metrics as ME
from cadenza.operators import sampling as S
from cadenza.operators import tags as T
from cadenza.operators.lexicon import full_lexicon
from cadenza.sources.tables import TagStore

LYRICS = ("[Verse 1] "
          "Yesterday All my troubles seemed so far away "
          "Now it looks as though they're here to stay "
          "Oh, I believe in yesterday "
          "[Verse 2] "
          "Suddenly "
          "I'm not half the man I used to be "
          "There's a shadow hanging over me "
          "Oh, yesterday came suddenly")


def _tokens(spark, col):
    return spark.createDataFrame([(LYRICS,)], "text string").select(col.alias("t")).first()["t"]


def test_preprocess_treebank_keep_stop(spark):
    expected = ["verse", "1", "yesterday", "all", "my", "troubles", "seemed", "so", "far", "away",
                "now", "it", "looks", "as", "though", "they", "'re", "here", "to", "stay",
                "oh", "i", "believe", "in", "yesterday", "verse", "2", "suddenly",
                "i", "'m", "not", "half", "the", "man", "i", "used", "to", "be",
                "there", "'s", "a", "shadow", "hanging", "over", "me",
                "oh", "yesterday", "came", "suddenly"]
    got = _tokens(spark, TX.preprocess(F.col("text"), "treebank", remove_stop=False, remove_punc=True))
    assert got == expected


def test_preprocess_treebank(spark):
    expected = ["verse", "1", "yesterday", "troubles", "seemed", "far", "away",
                "looks", "though", "'re", "stay", "oh", "believe", "yesterday",
                "verse", "2", "suddenly", "'m", "half", "man", "used",
                "'s", "shadow", "hanging", "oh", "yesterday", "came", "suddenly"]
    assert _tokens(spark, TX.preprocess(F.col("text"), "treebank")) == expected


def test_preprocess_wordpunct(spark):
    expected = ["verse", "1", "yesterday", "troubles", "seemed", "far", "away",
                "looks", "though", "stay", "oh", "believe", "yesterday",
                "verse", "2", "suddenly", "half", "man", "used",
                "shadow", "hanging", "oh", "yesterday", "came", "suddenly"]
    assert _tokens(spark, TX.preprocess(F.col("text"), "wordpunct")) == expected


def test_padding(spark):
    got = _tokens(spark, TX.pad_or_truncate(F.array(F.lit("a"), F.lit("b")), 4))
    assert got == ["a", "b", "<PAD>", "<PAD>"]
    got = _tokens(spark, TX.pad_or_truncate(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2))
    assert got == ["a", "b"]


def test_scoreboard_golden(spark):
    tags = ["aggressiiiiive", "not so aggressive", "not so aggressss",
            "jumpy", "nervou", "nervous", "gangst", "langstrumpf",
            "marilyn manson", "broodccast", "broodcast", "contemplative", "meditation"]
    tag_df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "tag_id long, tag string")
    tids = spark.createDataFrame([(1, "TR1")], "tid_id long, tid string")
    tid_tag = spark.createDataFrame([(1, i, 1.0, i) for i in range(len(tags))],
                                    "tid_id long, tag_id long, val double, tag_ord long")
    lex = full_lexicon()
    row = T.label_expanded(TagStore(tids, tag_df, tid_tag), lex).first().asDict()
    assert row["mood"] == "brooding"
    assert row["matched_mood"] == 1 and row["found_tags"] == len(tags)
    expected = dict.fromkeys(lex.moods_sorted, 0)
    expected.update(aggression=2, angst=2, brooding=3)
    assert {m: row[m] for m in lex.moods_sorted} == expected


def test_class_codes_golden(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(
        ["cat", "dog", "monkey", "monkey", "cat", "dog", "monkey"])], "i int, label string")
    got = [r["label_code"] for r in S.class_codes(df, "label").orderBy("i").collect()]
    assert got == [0, 1, 2, 2, 0, 1, 2]


def test_add_column(spark):
    df = spark.createDataFrame([(["b", "c"], ["e", "f"])], "a array<string>, d array<string>")
    out = FR.add_col_if_absent(df, "g", "h")
    assert out.columns == ["a", "d", "g"] and out.first()["g"] == "h"
    assert FR.add_col_if_absent(out, "a", "x").first()["a"] == ["b", "c"]


def test_split_sizes(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    for cuts, sizes in (((0.8, 0.9), {"train": 8, "dev": 1, "test": 1}),
                        ((0.6, 0.8), {"train": 6, "dev": 2, "test": 2})):
        sp = S.three_way_split(df, F.col("k"), seed=1, cuts=cuts)
        got = {r["split"]: r["n"] for r in sp.groupBy("split").count().withColumnRenamed("count", "n").collect()}
        assert got == sizes
        assert sp.select("k").distinct().count() == 10


def test_run_key(spark):
    df = spark.range(1).select(run_key(F.lit(300), F.array(F.lit(3), F.lit(4), F.lit(5)), F.lit(128),
                                       F.lit("0.001"), F.lit("0.01"), F.lit(128), F.lit(99999999),
                                       F.lit(0), F.lit(50000)).alias("k"))
    assert df.first()["k"] == "Em-300_FS-3-4-5_NF-128_D-0.001_L2-0.01_B-128_Ep-99999999_W2V-0_V-50000"


def test_percent_text(spark):
    df = spark.range(1).select(percent_text(F.lit(7702) / F.lit(10289)).alias("p"))
    assert df.first()["p"] == "74.86%"


CLASSES = ["anger", "calm", "happy", "sad"]
MATRIX = [[2372, 74, 32, 47], [203, 1661, 225, 431], [129, 289, 1982, 166], [284, 527, 180, 1687]]


def _cm_long(spark):
    rows = [(CLASSES[i], CLASSES[j], MATRIX[i][j]) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "label string, prediction string, n long")


def test_confusion_report_golden(spark):
    rep = {r["cls"]: r for r in ME.per_class_report(_cm_long(spark)).collect()}
    assert [rep[c]["total"] for c in CLASSES] == [2525, 2520, 2566, 2678]
    assert [rep[c]["incorrect"] for c in CLASSES] == [616, 890, 437, 644]
    assert rep["TOTAL"]["correct"] == 7702 and rep["TOTAL"]["total"] == 10289
    assert abs(rep["TOTAL"]["pct"] - 74.85664) < 1e-4


def test_confusion_scores_golden(spark):
    sc = {r["cls"]: r for r in ME.per_class_scores(_cm_long(spark)).collect()}
    assert [round(sc[c]["recall"], 5) for c in CLASSES] == [0.93941, 0.65913, 0.77241, 0.62995]
    assert [round(sc[c]["precision"], 5) for c in CLASSES] == [0.79384, 0.65112, 0.81935, 0.72372]
    assert [round(sc[c]["f1"], 5) for c in CLASSES] == [0.86051, 0.6551, 0.79519, 0.67359]


def test_confusion_long_fills_zero_cells(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, prediction string")
    cm = {(r["label"], r["prediction"]): r["n"] for r in ME.confusion_long(pairs).collect()}
    assert len(cm) == 9 and cm[("a", "b")] == 1 and cm[("b", "b")] == 0


def test_match_coverage_full_lexicon(spark):
    """Capitalised filter terms never hit the lower-cased tag; LIKE ignores case."""
    tags = ["Sophie Merry", "merry christmas", "cheerleader", "happy", "Happy Songs", "not happy"]
    tag_df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "tag_id long, tag string")
    tids = spark.createDataFrame([(1, "TR1"), (2, "TR2")], "tid_id long, tid string")
    tid_tag = spark.createDataFrame([(s, i, 1.0, i) for s in (1, 2) for i in range(len(tags))],
                                    "tid_id long, tag_id long, val double, tag_ord long")
    cov = {r["mood"]: r for r in T.match_coverage(TagStore(tids, tag_df, tid_tag), full_lexicon()).collect()}
    # cheerful: like 'cheer' / 'merry' hit 3 tags; 'cheerlead' filters one; 'Sophie Merry' never filters
    assert (cov["cheerful"]["like_rows"], cov["cheerful"]["like_rows_filtered"]) == (6, 4)
    assert cov["cheerful"]["exact_rows"] == 0 and cov["cheerful"]["pct"] == -1.0
    # happy: exact 'happy' only (case-sensitive equality); like hits 'happy', 'Happy Songs', 'not happy'
    assert cov["happy"]["exact_rows"] == 2
    assert (cov["happy"]["like_rows"], cov["happy"]["like_rows_filtered"]) == (6, 4)
