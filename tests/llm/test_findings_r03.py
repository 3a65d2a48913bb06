"""Caps and thresholds that VERDICT.md of round 2 lists: short lines, short benchmark items, single-text pairs, many labels."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import regex
from cadenza.llm import divergence, linededup, privacy, stringkernel, tiling
from cadenza.llm.common import Stages
from pyspark.sql import functions as F

SF2 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# pipeline, line_dedup

PROSE = regex.compile(r"(?<!\S)[\p{Ps}\p{Pi}\"']*[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*[\p{Pe}\p{Pf}\"'.,;:!?…]*(?!\S)")


def size(line):
    mostly = len(line.encode()) > 2 * len(line)
    bare = len(regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]", line)) // 2 if mostly else 0
    return 2 if line.count(" ") + 1 + bare >= 20 else 1 if len(PROSE.findall(line)) + bare >= 5 else 0


def stage(rows):
    """The stage in plain Python: (doc_id, site, text) to texts."""
    sites, first = defaultdict(set), {}
    for i, site, text in sorted(rows):
        for pos, x in enumerate(text.split("\n")):
            if key := x.strip(" \t\r"):
                sites[key].add(site or "")
                first.setdefault(key, (i, pos))
    many = max(3, -(-len({s for _, s, t in rows if t.strip(" \t\r\n")}) // 1000))
    out = {}
    for i, _, text in rows:
        lines = text.split("\n")
        bad = []
        for pos, x in enumerate(lines):
            key = x.strip(" \t\r")
            if key and first[key] != (i, pos) and len(sites[key]) >= (3 if size(key) == 2 else many):
                if not bad or pos - bad[-1][-1] > 2:
                    bad.append([])
                bad[-1].append(pos)
        gone = {p for run in bad if any(size(lines[p]) for p in run) for p in run}
        out[i] = [x for p, x in enumerate(lines) if p not in gone] or [""]
    return out


def test_line_stage_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.line_dedup(spark, docs, SF2).collect()}
    assert got == stage(rows)
    assert sum(map(len, got.values())) < sum(len(t.split("\n")) for *_, t in rows)


CODE = ["def run(self):", "    return None", "}", "else:", "import numpy as np", "for i in range(len(x)):",
        "public static void main(String[] args) {", "if __name__ == '__main__':", "    pass", "#include <stdio.h>"]
LISTS = ["- Yes.", "1.", "* No", "A.", "In.", "- milk", "Chapter 1", "Thanks!", "好的。", "目录"]
NOTICE = "All rights reserved by the owners of this site and its partners, no part may be copied without their written consent in advance."


def test_code_and_lists_stay_and_passages_go_with_many_sites(spark):
    rng = random.Random(1)
    rows = []
    for i in range(10_000):
        lines = [f"own line number {i} of this page"] + rng.choices(CODE + LISTS, k=6) + ["a remark that few pages share %d" % (i // 4)]
        if i % 2500 == 7:  # four sites of ten thousand
            lines += ["", "Contact", NOTICE, "Home"]
        rows.append((i, "\n".join(lines), "en", f"site{i}", 1))
    out = {r["doc_id"]: r["text"].split("\n") for r in
           corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert out == stage([(i, s, t) for i, t, _, s, _ in rows])
    assert [NOTICE in out[i] for i in (7, 2507, 5007, 7507)] == [True, False, False, False]
    clean = [(x, i) for i, t, *_ in rows for x in t.split("\n") if x != NOTICE]
    left = Counter((x, i) for i, lines in out.items() for x in lines)
    assert sum(left[c] > 0 for c in clean) >= 0.99 * len(clean)
    for x in CODE + LISTS:
        assert sum(x in t.split("\n") for _, t, *_ in rows) == sum(x in lines for lines in out.values())


def test_line_stage_on_odd_lines(spark):
    rows = [(i, f"x{i}\nAll rights reserved.\n\nThis sentence stands on every site of the table.\n\n\nYes.", "en", f"s{i}", 1) for i in range(4)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert out[0] == rows[0][1] and out[2] == "x2\n\n\n\nYes."  # one blank line may stand between, not two
    han = "本网站的所有内容均受版权保护未经许可不得转载或者使用请联系我们的客服人员了解更多信息谢谢合作"
    rows = [(i, f"页{i}\n{han}\n谢谢", "zh", f"s{i}", 1) for i in range(3)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert out == {0: rows[0][1], 1: "页1", 2: "页2"}
    lines = linededup.line_rows(spark.createDataFrame(rows, SCHEMA), words=True)
    assert {r["size"] for r in lines.where("pos = 1").collect()} == {2}


# op3, pipeline: decontaminate


def _report(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in tiling.contaminated(d, b, **options).select("doc_id", "item_id", "n_words", "coverage").collect())


def test_items_of_any_length_and_script(spark):
    items = [(1, "What is dark matter?"), (2, "光合作用发生在植物细胞的哪一个部分里面呢"), (3, "Paris"), (4, "ภาษาไทยเขียนโดยไม่เว้นวรรค"),
             (5, "the quick brown fox jumps over the lazy dog"), (6, "..."), (7, "水星")]
    docs = [(1, "they asked: what is dark matter? nobody knew"), (2, "what is matter, dark as it is"),
            (3, "练习题：光合作用发生在植物细胞的哪一个部分里面呢？答案见下"), (4, "光合作用是什么"), (5, "she went to paris"),
            (6, "คำว่า ภาษาไทยเขียนโดยไม่เว้นวรรค ครับ"), (7, "jumps over the lazy dog, the quick brown fox"), (8, "水星离太阳最近")]
    got = _report(spark, docs, items)
    assert [(d, i) for d, i, *_ in got] == [(1, 1), (3, 2), (5, 3), (6, 4), (7, 5), (8, 7)]
    assert all(c == (5 / 9 if i == 5 else 1.0) for _, i, _, c in got)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["doc_id"] for r in tiling.decontaminate(d, b).collect()) == [2, 4, 5, 8]  # one and two words drop nothing


def naive(docs, items, coverage=0.5, m=5):
    """Greedy string tiling on the words themselves, every document against every item."""
    out = []
    for d, text in docs:
        a = tiling.words(text)
        for i, item in items:
            b = tiling.words(item)
            if not b:
                continue
            k, ua, ub, total = min(m, len(b)), set(), set(), 0
            while True:
                best = max(((n, -y, -x) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y] and x not in ua and y not in ub
                            for n in [next((j for j in range(min(len(a) - x, len(b) - y)) if a[x + j] != b[y + j] or x + j in ua
                                            or y + j in ub), min(len(a) - x, len(b) - y))]), default=(0, 0, 0))
                if best[0] < k:
                    break
                n, y, x = best[0], -best[1], -best[2]
                ua.update(range(x, x + n))
                ub.update(range(y, y + n))
                total += n
            if total / len(b) >= coverage:
                out.append((d, i, len(b), total / len(b)))
    return sorted(out)


TEMPLATE = "read the following question and choose the best answer from the list"


def test_template_seeds_are_set_aside_and_no_link_is_lost(spark):
    rng = random.Random(4)
    own = lambda n: " ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(n))
    items = [(i, f"{TEMPLATE} {own(rng.randint(8, 24))}") for i in range(25)] + [(90, TEMPLATE)]
    docs = [(100 + i, f"{own(10)} {TEMPLATE} {own(10)}") for i in range(40)]
    docs += [(i, f"{own(4)} {items[i][1]} {own(4)}") for i in range(10)]
    docs += [(50 + i, " ".join(items[i][1].split()[12:]) + " " + own(3) + " " + TEMPLATE) for i in range(10)]
    assert _report(spark, docs, items) == naive(docs, items)
    d = tiling._rows(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 5, None, 0)
    b = tiling._rows(spark.createDataFrame(items[:25], "item_id long, text string"), "item_id", "text", 5, None, 0)
    named = b.select(F.col("id").alias("item_id"), F.col("t").alias("it"), F.col("n").alias("n_words"), "h", F.col("at").alias("i"))
    template = [int(h) for h in tiling.seeds(tiling.words(TEMPLATE))]
    rare = tiling._rare(named.join(d.select("h").distinct(), "h", "left_semi"), d, 0.5, 5)
    short = {r["id"] for r in b.where("n <= 24").collect()}  # the template alone reaches the coverage of these
    assert {r["item_id"] for r in rare.where(F.col("h").isin(template)).collect()} <= short


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 24])
def test_filter_of_any_power_of_two_loses_nothing(spark, bits):
    rng = random.Random(bits)
    items = [(i, " ".join(str(rng.randint(0, 400)) for _ in range(20))) for i in range(60)]
    docs = [(i, f"x {items[i][1]} y") for i in range(0, 60, 2)]
    assert _report(spark, docs, items, filter_bits=bits) == [(i, i, 20, 1.0) for i in range(0, 60, 2)]


def test_filter_rejects_other_sizes(spark):
    with pytest.raises(ValueError):
        _report(spark, [(1, "a")], [(1, "b")], filter_bits=64 * 262147)


# op4


def _near(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stages = Stages(spark, "test")
    rows = df.select("doc_id", F.xxhash64("text").alias("t"), "text")
    found = privacy.disclosures(stages.put(privacy._scan(rows, privacy.WINDOW), "scan"), rows, stages, least=0.0)
    return {r["term"]: r["disclosure"] for r in found.collect()}


def test_pairs_of_one_text_are_judged_and_copies_change_nothing(spark):
    filler = [f"some words about nothing in particular today {'number' if i % 2 else 'count'}" for i in range(200)]
    one = "write to zanzibarova at zan@some.org about words"
    got, twice = _near(spark, filler + [one]), _near(spark, filler + [one, one])
    assert got["zanzibarova"] == pytest.approx(2 / 3) and got["words"] < 0.1  # generalised, and left alone
    assert twice["zanzibarova"] == pytest.approx(2 / 3)
    many = _near(spark, filler + [f"write to zanzibarova at zan@some.org about words {chr(97 + i)}xx" for i in range(5)])
    assert many["zanzibarova"] == pytest.approx(10 / 11)  # removed
    df = spark.createDataFrame(list(enumerate(filler + [one])), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(df).collect()}
    assert clean[200].count("[TERM]") >= 1 and "zanzibarova" not in clean[200] and "words" in clean[200]
    assert all(clean[i] == t for i, t in enumerate(filler))


def test_letters_whose_lower_case_is_longer(spark):
    """One folding for contexts and counts: the pair of İstanbul is judged."""
    filler = ["nothing to see here at all"] * 50
    texts = filler + [f"from İstanbul mail me@x.org now {w}" for w in ("alpha", "beta", "gamma")]
    got = _near(spark, texts)
    assert got[privacy.folded("İstanbul")] > privacy.GENERALISE


def test_disclosures_are_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF2}/documents.parquet").select("text").collect()]
    n_e, n_t, n_et, shows = Counter(), Counter(), Counter(), defaultdict(set)
    for text in texts:
        entities, near = privacy.contexts(text, privacy.base_spans(text))
        n_e.update(entities)
        n_t.update({privacy.folded(w) for w in privacy._TERM.findall(text)})
        for pair in {(e, t) for e, t, *_ in near}:
            n_et[pair] += 1
            shows[pair].add(text)
    want = {}
    for (e, t), n in n_et.items():
        d = np.log(len(texts) * n / (n_e[e] * n_t[t])) / np.log(len(texts) / n_e[e]) * len(shows[e, t]) / (len(shows[e, t]) + 0.5)
        if d >= 0.6 + 1e-9:
            want[e, t] = d
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.xxhash64("text"))
    stages = Stages(spark, "test")
    rows = df.select("doc_id", "t", "text")
    got = {(r["entity"], r["term"]): r["disclosure"]
           for r in privacy.disclosures(stages.put(privacy._scan(rows, privacy.WINDOW), "scan"), rows, stages).collect()}
    assert set(want) <= set(got) and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert all(v < 0.6 + 1e-6 for k, v in got.items() if k not in want)


# op8


def test_three_hundred_labels_are_all_learned(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        own = random.Random(k)
        parts = ["".join(own.choice("abcdefghijklmnopqrstuvwxyzàéîõüß") for _ in range(3)) for _ in range(12)]
        rows += [(" ".join(rng.choice(parts) + rng.choice(parts) for _ in range(40)), f"l{k:03}") for _ in range(8)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = {r["doc_id"]: r["lang_pred"] for r in stringkernel.identify(docs).collect()}
    assert len(set(got.values())) == 300
    assert np.mean([got[i] == lang for i, (_, lang) in enumerate(rows)]) > 0.9


def test_factored_weights_give_the_same_outputs():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(20)) for _ in range(40)]
    sets = [stringkernel.grams(t) for t in texts]
    labels = [f"l{i % 20}" for i in range(40)]
    factored = stringkernel.fit_sets(sets, labels, landmarks=10)
    assert len(factored.weights) == 2
    whole = stringkernel.KernelModel(factored.labels, factored.vocabulary, [factored.weights[0] @ factored.weights[1]])
    assert np.allclose(factored.outputs(sets), whole.outputs(sets), atol=1e-4)
    assert re.match("l", factored.predict(texts)[0][0])


def test_terms_are_counted_in_arrays(spark, monkeypatch):
    """op13: whatever a task holds and however long a text is, the same counts; few rows leave the tasks."""
    texts = ["", "Aa aa, BB\nb-é É x1y", "ü" * 9, "1 2", "aa bb " * 30, " lead aa tail "]
    rows = [(t, f"l{i % 2}", f"s{k % 3}") for k, t in enumerate(texts) for i in range(4)] + [(None, None, "s0"), ("aa", "l0", None)]
    want = {}
    for t, lang, source in rows:
        key = (lang or "", source or "")
        want[(*key, None)] = (0, 0)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for w in set(words):
            n, d = want.get((*key, w), (0, 0))
            want[(*key, w)] = (n + words.count(w), d + 1)
    d = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    for held, cut in [(500_000, 1 << 22), (1, 1 << 22), (3, 5)]:
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "CUT", cut)
        got = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in divergence.term_counts(d).collect()}
        assert got == want
    one = pa.array(["aa bb " * 30])
    assert divergence._counted(one, np.zeros(1, np.int64)).to_pydict() == {"group": [0, 0], "term": ["aa", "bb"], "n": [30, 30], "docs": [1, 1]}
