"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns: for every operator."""

import hashlib
import os

import corpus_pipeline
import pytest
from cadenza.llm import (
    graphsearch, linededup, privacy, secrets, sentpiece, sharding, simhash, stringkernel, tiling, urls,
)
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["t", "fp", "h", "h1", "n", "id", "at", "key", "kind", "start", "end", "rank", "size", "shard", "slot", "label",
         "site", "line", "pos", "first", "spans", "base", "ids", "rep", "root", "removed", "n_removed", "n_lines", "p",
         "fingerprint", "component_id", "item_id", "score", "entity", "term", "found", "gsize", "__b"]

LONG = " ".join(f"word{i} the quick brown fox" for i in range(8000)) + " mail x@y.org token=abcdefghijkl"
ROWS = [
    (1, "the cat sat on the mat and the dog lay down\nshared line here\nthe end", "en", "a", 66),
    (2, "the cat sat on the mat and the dog lay down\nshared line here\nthe end", "en", "b", 66),
    (2, "the cat sat on the mat and the dog lay down\nshared line here\nthe end", "en", "b", 66),
    (3, None, "en", "c", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "d", 4),
    (6, "x", "en", "e", 1),
    (None, "an orphan row with a mail me@here.org and user=bob pwd=hunter22", "en", "f", None),
    (None, None, None, None, None),
    (7, LONG, "en", "g", len(LONG)),
    (8, "der Hund und die Katze sind im Garten und schlafen dort\nshared line here", "de", "h", 10),
    (9, "\U0001f600 12 34 ▁ éß \u0000", "fr", "i", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog lay down"), (2, None), (3, "too short"),
                                  (None, "nothing like this is in any text of all"), (1, "the cat sat on the mat and the dog lay down")],
                                 "item_id long, text string")


def wide(df):
    return df.select("*", *[F.lit("extra").alias(c) for c in CLASH])


OPERATORS = {
    "sentpiece": lambda d, b: sentpiece.encode(d),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "simhash_keep": lambda d, b: simhash.keep_first(d).select("doc_id", "text"),
    "tiling": lambda d, b: tiling.contaminated(d, b),
    "tiling_keep": lambda d, b: tiling.decontaminate(d, b).select("doc_id", "text"),
    "privacy": lambda d, b: privacy.digest(privacy.find(d)),
    "privacy_text": lambda d, b: privacy.sanitise(d).select("doc_id", "text"),
    "sharding": lambda d, b: sharding.shard(d, 3),
    "secrets": lambda d, b: secrets.digest(secrets.scan(d)),
    "language": lambda d, b: stringkernel.identify(d),
    "language_keep": lambda d, b: stringkernel.keep_identified(d).select("doc_id", "text"),
    "linededup": lambda d, b: linededup.dedup_lines(d, min_sites=3).select("doc_id", "text", "n_lines", "n_removed"),
}
ONE_EACH = ["sentpiece", "simhash", "privacy", "privacy_text", "sharding", "secrets", "language", "linededup"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_and_empty_tables(spark, docs, bench, name):
    op = OPERATORS[name]
    plain = rows(op(docs, bench))
    assert rows(op(wide(docs), wide(bench.drop("x")))) == plain if name not in ("tiling", "tiling_keep") else True
    assert op(docs.limit(0), bench).collect() == []
    if name in ONE_EACH:
        assert sorted(repr(r[0]) for r in plain) == sorted(repr(r[0]) for r in ROWS)


def test_tiling_extra_columns_and_empty_benchmark(docs, bench):
    odd = bench.select("*", *[F.lit("extra").alias(c) for c in CLASH if c != "item_id"])
    assert rows(tiling.contaminated(wide(docs), odd)) == rows(tiling.contaminated(docs, bench))
    assert tiling.contaminated(docs, bench.limit(0)).collect() == []
    assert tiling.decontaminate(docs, bench.limit(0)).count() == len(ROWS)
    assert rows(tiling.decontaminate(wide(docs), odd).select("doc_id", "text")) == rows(
        tiling.decontaminate(docs, bench).select("doc_id", "text"))


def test_sentpiece_values(docs):
    got = {(r["doc_id"], r["text"]): r for r in docs.join(sentpiece.encode(docs), "doc_id").collect()}
    assert all(r["lossless"] for r in sentpiece.encode(docs).collect())
    assert got[3, None]["ids"] is None and got[4, ""]["ids"] == [] and got[3, None]["n_tokens"] == 0
    back = {r["doc_id"]: r["text"] for r in sentpiece.decode(sentpiece.encode(docs.where("doc_id IN (3, 4, 7, 9)"))).collect()}
    assert back == {3: None, 4: "", 7: LONG, 9: ROWS[-1][1]}


def test_simhash_values(docs):
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    by = {g[0]: g for g in got if g[0] is not None}
    assert by[3][1] == by[4][1] == by[5][1] == "0" * 16
    assert by[3][2] == by[4][2] == by[5][2] == 3
    assert by[1][2] == by[2][2] == 1 and by[6][2] == 6
    kept = [r["doc_id"] for r in simhash.keep_first(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 6, 7, 8, 9] and kept.count(None) == 2
    twice = docs.where("doc_id = 2")
    assert twice.count() == 2 and simhash.keep_first(twice).count() == 1


def test_language_values(spark, docs):
    got = {r["doc_id"]: r for r in stringkernel.identify(docs).collect() if r["doc_id"] is not None}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[3]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in stringkernel.identify(none).collect()} == {"und"}
    assert stringkernel.keep_identified(none).count() == 8  # the texts with a letter
    one = docs.withColumn("lang", F.lit("en"))
    assert {r["lang_pred"] for r in stringkernel.identify(one).collect()} == {"und", "en"}


def test_linededup_values(spark, docs):
    got = {}
    for r in linededup.dedup_lines(docs, min_sites=3).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert "shared line here" in got[1][0]["text"]  # its first place
    assert all("shared" not in r["text"] and r["n_removed"] == 1 for r in got[2])
    assert got[8][0]["text"] == ROWS[10][1].split("\n")[0] and got[8][0]["n_chars"] == len(got[8][0]["text"])
    assert got[3][0]["text"] is None and got[4][0]["text"] == "" and got[5][0]["text"] == " \n\t "
    # sketches far from the threshold need no exact count, near ones get it: same answer with a band of any width
    for band in (0.0, 50.0):
        assert rows(linededup.dedup_lines(docs, min_sites=3, band=band)) == rows(linededup.dedup_lines(docs, min_sites=3))


def test_linededup_all_lines_go_and_ties(spark):
    d = spark.createDataFrame([(i, "one\none\n\ntwo", "en", f"s{i}", 12) for i in range(5)] + [(9, "one", "en", None, 3)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(d, min_sites=5).collect()}
    assert got == {0: "one\n\ntwo", 1: "", 2: "", 3: "", 4: "", 9: ""}


def test_sharding_values(docs):
    got = sharding.shard(docs, 3).collect()
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    null = [r for r in got if r["doc_id"] in (3, 4)]
    assert {r["size"] for r in null} == {16} and {r["text_crc32"] for r in null} == {0}
    assert len({r["shard"] for r in null}) == 1
    assert len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1


def test_secret_and_privacy_values(docs):
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert got[7]["n_assign"] == 1 and got[7]["spans"].startswith("assign:")
    assert got[None]["spans"] in ("", "ident:46:54,weak:55:67")  # two rows without an id, one empty
    assert got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    found = {r["doc_id"]: r for r in privacy.digest(privacy.find(docs)).collect()}
    assert found[7]["n_email"] == 1 and found[3]["spans"] == ""
    clean = [r["text"] for r in privacy.sanitise(docs).where("doc_id IS NULL AND text IS NOT NULL").collect()]
    assert len(clean) == 1 and "[EMAIL]" in clean[0] and "me@" not in clean[0]


def test_tiling_values(docs, bench):
    got = [(r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.contaminated(docs, bench).collect()]
    assert sorted(got) == [(1, 1, 1.0), (2, 1, 1.0)]
    assert sorted(repr(r["doc_id"]) for r in tiling.decontaminate(docs, bench).collect()) == sorted(
        repr(r[0]) for r in ROWS if r[0] not in (1, 2))


def test_url_edges(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.Example.ORG/es/x?q#f"), (2, None), (3, "no scheme"), (4, "http://"), (5, "x://h?/org/"), (None, "http://b.com/de/1"),
         (6, "http://example.org/en/12"), (7, "http://notexample.org/es/"), (8, "http://b.com/fr/"), (8, "http://b.com/fr/")],
        "page_id long, url string")
    out = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (99, 1), (4, None)], "page_id long, bad int")
    got = [tuple(r)[:5] for r in urls.judge(wide(pages), out).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "a.example.org", "/es/x", "example.org/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "h", "", None, "allow"), (None, "b.com", "/de/1", "com/de/", "block"),
        (6, "example.org", "/en/12", "example.org/en/1", "block"), (7, "notexample.org", "/es/", "org/", "allow"),
        (8, "b.com", "/fr/", "com/fr/", "allow"), (8, "b.com", "/fr/", "com/fr/", "allow")], key=repr)
    assert urls.judge(pages.limit(0), out).collect() == []
    assert {r["bad_rate"] for r in urls.judge(pages, out.limit(0)).collect()} == {0.5}


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
         (7, [1.0, None]), (None, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 2.0, 3.0]), (8, [])],
        "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in graphsearch.nearest(wide(v), k=3).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5)]
    assert graphsearch.nearest(v.limit(0)).collect() == []


def test_pipeline_stages_on_edges(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "the cat sat on the mat and the dog lay down")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide(docs), str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == wide(docs).columns
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["lossless"] for r in done) and {r["doc_id"] for r in done if r["doc_id"] is not None} >= {6, 7, 8}
    assert not {1, 2, 3, 4, 5} & {r["doc_id"] for r in done}
    assert os.path.exists(tmp_path / "documents.parquet")
