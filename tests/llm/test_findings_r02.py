
import random

import corpus_pipeline
import pytest
from cadenza.llm import queries, stringkernel

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# pipeline, line_dedup


def _lines(texts):
    return {i: t.split("\n") for i, t in texts.items()}


def test_long_passage_on_few_sites_goes(spark):
    """A passage of 60 words on 3 and on 9 sites, and a table that has three sources in all."""
    long3, long9 = (" ".join(f"{w}{i}" for i in range(60)) for w in ("few", "more"))
    many = [(i, f"own {i}\n{long9}" + (f"\n{long3}" if i < 3 else ""), "en", f"s{i}", 1) for i in range(9)]
    many += [(20 + i, f"own {20 + i}\non two sites", "en", f"s{10 + i % 2}", 1) for i in range(11)]
    small = [(i, f"own {i}\n{long3}\nAll rights reserved.", "en", f"s{i % 3}", 1) for i in range(6)]
    for rows, gone in ((many, {long3, long9}), (small, {long3, "All rights reserved."})):
        out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
        want = {r[0]: [x for x in r[1].split("\n") if r[0] == 0 or x not in gone] for r in rows}
        assert _lines({r["doc_id"]: r["text"] for r in out}) == want


# pipeline, language_id


FOREIGN = ["Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес", "素早い茶色の狐がのろまな犬を飛び越えて森へ逃げていく",
           "xqzj kkwq zzxv qqpw vvkx jjzq wxyz xqzj kkwq zzxv qqpw"]


def _language(seed, rng):
    own = random.Random(seed)
    parts = ["".join(own.choice("abcdefghijklmnoprstuvyéèüöñçåøšž") for _ in range(own.choice([2, 3]))) for _ in range(40)]
    return lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("labels", [1, 2, 4, 160])
def test_rejection_does_not_depend_on_the_number_of_labels(spark, labels):
    rng = random.Random(labels)
    rows = []
    for k in range(labels):
        say = _language(k, rng)
        rows += [(say(rng.randint(30, 60)), f"l{k:03}") for _ in range(max(20, 80 // labels))]
        rows += [(say(8), f"l{k:03}")]
    foreign = FOREIGN if labels > 1 else FOREIGN[:2]  # one label has no second to tell its own script's texts by
    rows += [(t, None) for t in foreign]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(rows)], SCHEMA)
    kept = [r["lang"] for r in corpus_pipeline.language_id(spark, docs, "").collect()]
    assert None not in kept
    assert len(kept) >= 0.99 * (len(rows) - len(foreign))


def test_margin_is_best_less_second():
    sets = [stringkernel.grams(t) for t in ("the cat sat", "der hund lief", "le chat dort", "the dog ran")]
    model = stringkernel.fit_sets(sets, ["en", "de", "fr", "en"])
    two = sorted(model.outputs(sets[:1])[0])[-2:]
    assert model.predict(["the cat sat"])[2][0] == pytest.approx((two[1] - two[0]) / model.typical, abs=1e-5)
    assert list(model.predict([None, "12"])[2]) == [0, 0]


# op6


def test_toxic_page_without_quality_is_bad(spark, tmp_path):
    """Toxic without quality blocks its host, no quality and not toxic (or unknown) teaches nothing."""
    pages = [(i, f"http://{h}.net/{i}") for i in range(90) for h in (("bad", "good", "none")[i % 3],)]
    labels = [(i, None if i % 3 != 1 else 1.0, (1, 0, (0, None)[i % 2])[i % 3]) for i in range(90)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality double, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["page_id"]: r["verdict"] for r in queries.QUERIES["op6_url_reputation"](spark, str(tmp_path)).collect()}
    assert got == {i: "block" if i % 3 == 0 else got[2] if i % 3 == 2 else "allow" for i in range(90)}
