"""Exact segment search, fill-in-the-middle and source divergence: brute force, round trips, DuckDB and edges."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from cadenza.llm import divergence, piecetable, segmentsearch
from pyspark.sql import functions as F

from test_edges import LONG, ROWS, SCHEMA, docs, rows, wide  # noqa: F401

# op11


def brute(vectors, every, k):
    """Rows as the query gives them, by Python integers."""
    seen = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in vectors if i is not None and v is not None
                   and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, q in seen:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in seen if j != i and len(v) == len(q))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(found, 1)]
    return sorted(out)


def clustered(n, dim, seed):
    """Centres with means and spreads of their own: bounds can tell them apart."""
    g = np.random.default_rng(seed)
    centre = g.normal(0, 1, (12, dim)) * g.choice([0.2, 1, 4], 12)[:, None] + g.normal(0, 1, 12)[:, None]
    return [(i, [float(x) for x in centre[i % 12] + g.normal(0, 0.1, dim)]) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 16, 37])
def test_search_is_brute_force(spark, dim):
    v = clustered(400, dim, dim)
    got = segmentsearch.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>"), every=7, k=5, block=20)
    assert sorted(tuple(r) for r in got.collect()) == brute(v, 7, 5)


def test_bounds_hold_at_every_level_and_prune():
    v = clustered(3000, 64, 1)
    x = np.floor(256 * np.array([r for _, r in v]))
    s, ids = segmentsearch.statistics(x), np.arange(len(x))
    exact = x[:50] @ x.T
    at = 0
    for n in segmentsearch.levels(64):
        part = s[:, at: at + 2 * n]
        assert np.allclose((part ** 2).sum(axis=1), (x ** 2).sum(axis=1))  # so the distance's bound bounds the product
        assert (part[:50] @ part.T >= exact - 1e-6 * np.abs(exact) - 1e-6).all()
        at += 2 * n
    block = segmentsearch.Block(ids[:50], x[:50], s[:50], 5)
    for a in range(0, len(x), 500):
        block.meet(ids[a: a + 500], x[a: a + 500], s[a: a + 500])
    assert block.scored < 0.5 * exact.size
    want = [sorted((-int(exact[i, j]), j) for j in range(len(x)) if j != i)[:5] for i in range(50)]
    assert [[(-a, b) for a, b in best] for best in block.best] == want


def test_search_ties_and_huge_components(spark):
    big = [(i, [float(3 ** (i % 5)) * 4e4, -5e4 * i, 1 / 3, 2.0 ** 20]) for i in range(60)]  # products beyond 2^53
    same = [(100 + i, [0.5, 0.5, 0.25, -1.0]) for i in range(60)]
    for v in (big, same, big + same):
        got = segmentsearch.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>"), every=10, k=5)
        assert sorted(tuple(r) for r in got.collect()) == brute(v, 10, 5)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (1, [1.0, -0.001]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
         (7, [1.0, None]), (None, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (150, []), (8, []),
         (-50, [0.0, 0.0]), (200, [2.0, 1.0]), (200, [1.0, 2.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in segmentsearch.top_k(wide(df)).collect())
    assert got == sorted(brute(v, 50, 5)) and (150, 1, 8, 0) in got
    assert segmentsearch.top_k(df.limit(0)).collect() == []
    assert segmentsearch.top_k(df.where("vec_id = 1")).collect() == []


# op12


def naive(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[i: i + 8], 16) for i in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle_is_the_naive_one_and_restores():
    g = random.Random(5)
    pool = ["word", " ", "\n", "é", "日", "\U0001f600", "<", ">", "P>", "<S", "M", "7", "Z", "\x00"]
    texts = ["".join(g.choice(pool) for _ in range(g.randint(0, 40))) for _ in range(3000)] + ["<P>", "a<M>b", "<", "x"]
    forms = Counter()
    for i, t in enumerate(texts):
        table, *got = piecetable.transform(t.encode(), i)
        assert (*got, bytes(table).decode()) == naive(i, t)
        assert bytes(piecetable.PieceTable(bytes(table)).restore(got[1])).decode() == t
        assert table.sha256() == hashlib.sha256(bytes(table)).hexdigest()
        forms[got[1]] += 1
    assert 0.15 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.25 and forms["plain"] > 250


def test_pieces_split_and_never_copy():
    text = b"abcdefgh"
    table = piecetable.PieceTable(text)
    parts = table.cut(2, 2, 5)
    assert [bytes(piecetable.PieceTable(text, p)) for p in parts] == [b"ab", b"", b"cde", b"fgh"]
    assert all(m.obj in (text, piecetable.SENTINELS) for m in table.arrange(table.cut(2, 5), "psm").stream())
    with pytest.raises(ValueError):
        piecetable.PieceTable(b"no sentinels").restore("psm")


def test_fill_in_middle_edges(docs):  # noqa: F811
    got = piecetable.fill_in_middle(wide(docs)).collect()
    assert len(got) == len(ROWS)
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (repr(r["doc_id"]), r["n"])),
                             sorted(ROWS, key=lambda r: (repr(r[0]), naive(r[0], r[1] or "")[0]))):
        assert tuple(r)[1:6] == naive("" if i is None else i, t or "")
    back = piecetable.restore(piecetable.fill_in_middle(docs).withColumn("restored", F.lit("clash"))).collect()
    assert sorted(r["restored"] for r in back) == sorted(t or "" for _, t, *_ in ROWS)
    assert all(r["restored_sha256"] == hashlib.sha256(r["restored"].encode()).hexdigest() for r in back)
    assert piecetable.restore(piecetable.fill_in_middle(docs.limit(0))).collect() == []


# op13


def audited(docs, **options):  # noqa: F811
    return rows(divergence.audit(docs, **options))


def plain(data, min_docs=3, top=200):
    """Every kept term of every pair by Python integers."""
    count, df = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source, *_ in data:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        g = lang or "", source or ""
        groups.add(g)
        count[g].update(words)
        df[g[0]].update(set(words))
    f = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        total = sum((count[g] for g in groups if g[0] == lang), Counter())

        def share(c):
            n = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (c[t] + 1) // n for t in kept}

        p, q = share(count[lang, source]), share(total)
        pair = [(-sum(f(p[t], r[t]) for t in kept), s) for a, s in groups if a == lang and s != source
                for r in [share(count[a, s])]]
        term = [(-f(p[t], q[t]), t) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pair)), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -v, n) for n, (v, item) in enumerate(items, 1)]
    return sorted(out, key=repr)


def test_divergence_is_brute_force_on_odd_texts(spark):
    g = random.Random(3)
    words = ["the", "The", "cat", "Éa", "éa", "straße", "x1y", "日本", "\U0001f600", "rare"]
    data = [(i, " ".join(g.choice(words[: 2 + i % 9]) for _ in range(g.randint(0, 30))), g.choice(["en", "de", None, "solo"]), None, 0)
            for i in range(200)]
    data = [(i, t, lang, "only" if lang == "solo" else g.choice(["a", "b", "c", "", None, "ü"]), n) for i, t, lang, _, n in data]
    df = spark.createDataFrame(data, SCHEMA)
    want = plain(data)
    assert audited(df) == want
    assert rows(divergence.audit(df, min_docs=1, top_terms=2)) == plain(data, 1, 2)


def test_divergence_edges(spark, docs):  # noqa: F811
    assert audited(wide(docs)) == plain(ROWS)
    assert audited(docs.union(docs)) == plain(ROWS + ROWS)
    assert audited(docs.limit(0)) == []
    empty = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, "one", "en", "c", 0)], SCHEMA)
    assert audited(empty) == sorted([("en", s, "pair", o, 0, n) for s, others in (("a", "bc"), ("b", "ac"), ("c", "ab"))
                                     for n, o in enumerate(others, 1)], key=repr)
    assert [w for part in divergence._words(LONG, cut=50) for w in part] == re.findall(rb"[a-z\x80-\xff]+", LONG.lower().encode())


def test_tree_corrects_each_node_once_for_all_its_terms():
    tree = divergence.Tree()
    row = ([0, 1, 2], [5, 1, 1], [60, 20, 30], [10, 10, 10])
    tree.insert(*row, 1000)
    tree.insert([0, 1], [5, 1], [60, 20], [10, 10], 7)  # out of order on purpose: a prefix closes what was below it
    tree.close(0)
    tree.correct()
    assert tree.nodes == 3
    f = lambda p, q: (p - q) ** 2 // q
    rest = lambda p, q: f(p, q) - f(p, 10) - f(10, q) + f(10, 10)
    got = {(a, b): v for a, b, v in tree.take()}
    assert got[0, 1] == 1007 * rest(60, 20) and got[1, 0] == 1007 * rest(20, 60)
    assert got[0, 2] == 1000 * rest(60, 30) and got[2, 1] == 1000 * rest(30, 20)


def test_divergence_partitions_of_the_tree_add_up(spark):
    data = [(i, " ".join(f"w{chr(97 + i % 7)}{chr(97 + j % 11)}" for j in range(i % 40)), "en", f"s{i % 6}", 0) for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA)
    want = audited(df)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert audited(df) == want == plain(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_divergence_sql_says_the_same_on_ties(spark):
    data = [(i, "aa bb cc" if i % 2 else "bb cc dd dd", "en", f"s{i % 4}", 0) for i in range(40)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", data)
    got = audited(spark.createDataFrame(data, SCHEMA))
    assert got == sorted(con.sql(divergence.ORACLE).fetchall(), key=repr)
