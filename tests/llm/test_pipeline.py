"""The whole pipeline against its five stages in plain Python, over all of the small tables."""

import corpus_pipeline
import pytest
from cadenza.llm import sentpiece, stringkernel, tiling

from test_findings_r03 import naive, stage
from test_methods import naive_classes, naive_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain(spark):
    """Texts by doc_id after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    out = []
    # the model is fitted by the operator, whose formula test_methods checks; its use is plain here
    model = stringkernel.fit(docs.where(~stringkernel.held_out()))
    names, _, shares = model.predict([t for _, t in rows.values()])
    kept = {i: r for (i, r), name, share in zip(rows.items(), names, shares) if name != "und" and share >= stringkernel.MIN_SHARE}
    out.append({i: t for i, (_, t) in kept.items()})
    lines = stage([(i, site, t) for i, (site, t) in kept.items()])
    out.append({i: "\n".join(x) for i, x in lines.items()})
    classes = naive_classes({i: naive_fingerprint(t) for i, t in out[-1].items()}, 2)
    out.append({i: t for i, t in out[-1].items() if classes[i] == i})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(t[i: i + 5]) for i in range(len(t) - 4)}  # noqa: E731  a tile has five words in a row
    known = [(i, t, grams(tiling.words(t))) for i, t in items]
    bad = set()
    for i, text in out[-1].items():
        mine = grams(tiling.words(text))
        near = [(j, t) for j, t, g in known if len(g & mine) * 10 >= len(tiling.words(t))]
        if near and naive([(i, text)], near):
            bad.add(i)
    out.append({i: t for i, t in out[-1].items() if i not in bad})
    return out


def test_whole_run_is_brute_force(spark, plain):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == plain[-1].keys()
    assert len(plain[0]) > len(plain[2]) > len(plain[3])  # each of the filters had something to do
    assert plain[0] != plain[1]
    enc = sentpiece.Encoder(sentpiece.Vocabulary.load(sentpiece.MODEL))
    want = enc.encode([*plain[-1].values()], [*plain[-1]]).to_pylist()
    assert [got[i]["ids"] for i in plain[-1]] == want
    assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_clean_documents_stay(spark, plain):
    """Of documents without a repeated line, a near copy or a benchmark item all stay as they are."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    final = plain[-1]
    touched = {i for i in rows if final.get(i) != rows[i]}
    assert all(final[i] == t for i, t in rows.items() if i not in touched)
    assert len(plain[0]) >= 0.97 * len(rows)
