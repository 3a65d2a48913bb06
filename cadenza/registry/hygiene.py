"""Census and hygiene queries over the song rows (A12, A13, A15, A24,
P9-P13, U3) and seeded sampling (W8, W10, W11, M8, F10, L6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as TX
from cadenza.operators import frames as FR
from cadenza.operators import sampling as S
from cadenza.plans.dataset import build_dataset
from cadenza.registry.base import query
from cadenza.registry.songs import _SPLIT_SQL
from cadenza.registry.sqlparts import line_shuffle_sql, preprocess_sql, word_count_sql
from cadenza.sources.songs import labelled_documents
from cadenza.sources.tables import read_table

_WC = word_count_sql("text")
_DOCS_WC = f"dw AS (SELECT *, {_WC} AS wordcount FROM documents)"


def _docs(spark, sf):
    return labelled_documents(spark, sf)


@query("wordcount_describe", f"""WITH {_DOCS_WC}
SELECT count(wordcount) AS count, round(avg(wordcount), 5) AS mean, round(stddev_samp(wordcount), 5) AS std,
       CAST(min(wordcount) AS DOUBLE) AS min, round(quantile_cont(wordcount, 0.25), 5) AS p25,
       round(quantile_cont(wordcount, 0.5), 5) AS p50, round(quantile_cont(wordcount, 0.75), 5) AS p75,
       CAST(max(wordcount) AS DOUBLE) AS max FROM dw""")
def q_wordcount_describe(spark, sf):
    """describe() of the word count."""
    return FR.describe_numeric(_docs(spark, sf), "wordcount")


@query("length_cutoff", f"""WITH {_DOCS_WC}
SELECT CAST(floor(quantile_cont(wordcount, 0.75)) AS INTEGER) AS cutoff FROM dw""")
def q_length_cutoff(spark, sf):
    """int(75th percentile) of the word count (exact, interpolated)."""
    return FR.length_cutoff(_docs(spark, sf), "wordcount")


@query("wordcount_range", f"""WITH {_DOCS_WC}
SELECT 'lt10' AS bucket, doc_id, wordcount FROM dw WHERE wordcount < 10
UNION ALL SELECT '10_15', doc_id, wordcount FROM dw WHERE wordcount > 10 AND wordcount < 15
UNION ALL SELECT '15_20', doc_id, wordcount FROM dw WHERE wordcount > 15 AND wordcount < 20
UNION ALL SELECT 'gt1000', doc_id, wordcount FROM dw WHERE wordcount > 1000""")
def q_wordcount_range(spark, sf):
    """Strict open ranges; a row exactly on a bound is in neither range."""
    d = _docs(spark, sf).select("doc_id", "wordcount")
    parts = [("lt10", None, 10), ("10_15", 10, 15), ("15_20", 15, 20), ("gt1000", 1000, None)]
    out = None
    for name, lo, hi in parts:
        one = FR.open_range(d, "wordcount", lo, hi).select(F.lit(name).alias("bucket"), "doc_id", "wordcount")
        out = one if out is None else out.unionByName(one)
    return out


@query("min_wordcount", f"""WITH {_DOCS_WC}
SELECT doc_id, wordcount FROM dw WHERE wordcount > 10""")
def q_min_wordcount(spark, sf):
    """P10: minimum word count filter."""
    return FR.open_range(_docs(spark, sf), "wordcount", bottom=10).select("doc_id", "wordcount")


@query("every_kth_preview", f"""WITH {_DOCS_WC}
SELECT doc_id, wordcount FROM dw WHERE wordcount > 10 AND wordcount < 400 AND doc_id % 8 = 0
ORDER BY doc_id LIMIT 10""")
def q_every_kth_preview(spark, sf):
    """Every 8th row (by index) inside a word-count range, first 10 (a preview)."""
    d = FR.open_range(_docs(spark, sf), "wordcount", 10, 400)
    return FR.every_kth(d, "doc_id", 8, 10).select("doc_id", "wordcount")


@query("null_census", """
SELECT 'doc_id' AS column_name, count(*) FILTER (WHERE doc_id IS NULL) AS n_null FROM labels
UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM labels
UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM labels
UNION ALL SELECT 'genre', count(*) FILTER (WHERE l.doc_id IS NULL) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_null_census(spark, sf):
    """NULLs per column (the genre column after a left join has many)."""
    labels = read_table(spark, sf, "labels")
    base = FR.null_census(labels.select("doc_id", "quality", "toxic"))
    docs = read_table(spark, sf, "documents").select("doc_id")
    joined = docs.join(labels.select(F.col("doc_id").alias("g"), F.col("doc_id")), "doc_id", "left")
    genre = FR.null_census(joined.select(F.col("g").alias("genre")))
    return base.unionByName(genre)


@query("instrumental_count", """
SELECT count(*) FILTER (WHERE text IS NOT NULL AND contains(lower(text), 'the')) AS n_with_word,
       count(*) FILTER (WHERE text IS NOT NULL AND contains(lower(text), 'instrumental')) AS n_instrumental
FROM documents""")
def q_instrumental_count(spark, sf):
    """Texts whose lower-case form contains a word ('instrumental', 'the')."""
    d = read_table(spark, sf, "documents")
    return d.agg(FR.contains_count(d, "text", "the").alias("n_with_word"),
                 FR.contains_count(d, "text", "instrumental").alias("n_instrumental"))


@query("filter_funnel", """
WITH s AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END AS lyrics_available,
                  CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS is_english,
                  CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS matched_mood FROM orders),
c AS (SELECT count(*) AS s0,
             count(*) FILTER (WHERE lyrics_available = 1) AS s1,
             count(*) FILTER (WHERE lyrics_available = 1 AND is_english = 1) AS s2,
             count(*) FILTER (WHERE lyrics_available = 1 AND is_english = 1 AND matched_mood = 1) AS s3 FROM s)
SELECT 'start' AS step, 0 AS step_ord, s0 AS n FROM c
UNION ALL SELECT 'lyrics_available', 1, s1 - s0 FROM c
UNION ALL SELECT 'is_english', 2, s2 - s1 FROM c
UNION ALL SELECT 'matched_mood', 3, s3 - s2 FROM c
UNION ALL SELECT 'remaining', 4, s3 FROM c""")
def q_filter_funnel(spark, sf):
    """Rows at start, lost per step, remaining - one pass."""
    o = read_table(spark, sf, "orders")
    steps = [("lyrics_available", F.col("o_orderpriority") != "5-LOW"),
             ("is_english", F.col("o_orderstatus") != "P"),
             ("matched_mood", F.col("o_totalprice") > 100000)]
    return FR.filter_funnel(o, steps)


@query("first_char_census", "SELECT substr(p_name, 1, 1) AS first_char, count(*) AS n FROM part GROUP BY 1")
def q_first_char_census(spark, sf):
    """Rows per first character of a name column (the work-sharding census)."""
    return FR.first_char_census(read_table(spark, sf, "part"), "p_name")


@query("dedupe", """
SELECT text_key, doc_id FROM (
  SELECT md5(text) AS text_key, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn
  FROM documents) WHERE rn = 1""")
def q_dedupe(spark, sf):
    """One row per lyric text (exact copies collapse), lowest id wins."""
    d = read_table(spark, sf, "documents").select(F.md5("text").alias("text_key"), "doc_id")
    return FR.dedupe_by(d, "text_key", [F.col("doc_id")])


# ---------------------------------------------------------------- sampling

@query("split_80_10_10", "WITH " + _SPLIT_SQL + "\nSELECT doc_id, CAST(rk AS BIGINT) AS rank, split FROM split")
def q_split(spark, sf):
    """Exact seeded 80/10/10 split (bucketed global index)."""
    d = read_table(spark, sf, "documents").select("doc_id")
    return S.three_way_split(d, F.col("doc_id"), seed=42, with_rank=True).select("doc_id", "rank", "split")


@query("split_60_20_20", """
SELECT doc_id, CASE WHEN rk < floor(n * 0.6) THEN 'train' WHEN rk < floor(n * 0.8) THEN 'dev' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS rk,
             count(*) OVER () AS n FROM documents)""")
def q_split_60(spark, sf):
    """W8 with the .6/.8 cuts of the notebook."""
    d = read_table(spark, sf, "documents").select("doc_id")
    return S.three_way_split(d, F.col("doc_id"), seed=7, cuts=(0.6, 0.8)).select("doc_id", "split")


@query("epoch_batches", """
SELECT e.epoch, d.doc_id,
       CAST(row_number() OVER (PARTITION BY e.epoch ORDER BY md5('42|' || CAST(e.epoch AS VARCHAR) || '|' || CAST(d.doc_id AS VARCHAR)),
                                  CAST(e.epoch AS VARCHAR) || '|' || CAST(d.doc_id AS VARCHAR)) - 1 AS BIGINT) AS position,
       CAST(floor((row_number() OVER (PARTITION BY e.epoch ORDER BY md5('42|' || CAST(e.epoch AS VARCHAR) || '|' || CAST(d.doc_id AS VARCHAR)),
                                  CAST(e.epoch AS VARCHAR) || '|' || CAST(d.doc_id AS VARCHAR)) - 1) / 128) AS BIGINT) AS batch
FROM documents d, (SELECT CAST(range AS INTEGER) AS epoch FROM range(1, 4)) e""")
def q_epoch_batches(spark, sf):
    """Three epochs, each a fresh seeded order, batches of 128."""
    d = read_table(spark, sf, "documents").select("doc_id")
    return S.epoch_batches(d, F.col("doc_id"), epochs=3, batch_size=128, seed=42).select(
        "epoch", "doc_id", "position", "batch")


@query("line_shuffle", f"""
SELECT doc_id, {line_shuffle_sql('text', "CAST(doc_id AS VARCHAR)")} AS shuffled FROM documents""")
def q_line_shuffle(spark, sf):
    """every text with its lines in a seeded order."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", TX.line_shuffle(F.col("text"), F.col("doc_id").cast("string"), 42)
                    .alias("shuffled"))


_BAL_SQL = f"""
WITH d AS (SELECT doc_id, lang AS mood, text FROM documents),
c AS (SELECT mood, count(*) AS n FROM d GROUP BY mood),
p AS (SELECT mood, n, CAST(floor((max(n) OVER () - n) / n) AS INTEGER) AS copies,
             max(n) OVER () - n - floor((max(n) OVER () - n) / n) * n AS rest FROM c),
j AS (SELECT d.*, p.copies, p.rest FROM d JOIN p ON d.mood = p.mood),
orig AS (SELECT doc_id, mood, text, 0 AS copy FROM j),
full_copies AS (SELECT doc_id, mood, text, CAST(g.copy AS INTEGER) AS copy
                FROM j, LATERAL (SELECT unnest(range(1, j.copies + 1)) AS copy) g WHERE j.copies > 0),
rest AS (SELECT doc_id, mood, text, copies + 1 AS copy FROM (
           SELECT j.*, row_number() OVER (PARTITION BY mood ORDER BY md5('42|pad|' || CAST(doc_id AS VARCHAR)),
                                          CAST(doc_id AS VARCHAR)) - 1 AS r FROM j WHERE rest > 0) WHERE r < rest),
cp AS (SELECT doc_id, mood, copy,
              {line_shuffle_sql('text', "(CAST(doc_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR))")} AS text
       FROM (SELECT * FROM full_copies UNION ALL SELECT * FROM rest))
SELECT doc_id, mood, copy, md5(text) AS text_md5 FROM orig
UNION ALL SELECT doc_id, mood, copy, md5(text) FROM cp"""


@query("balance_classes", _BAL_SQL)
def q_balance_classes(spark, sf):
    """M8: oversample every language class up to the largest; copies get
    shuffled lines. Output carries an md5 of the (shuffled) text."""
    d = read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("mood"),
                                                  F.col("text").alias("lyrics"))
    b = S.balance_classes(d, "mood", F.col("doc_id"), "lyrics", seed=42)
    return b.select("doc_id", "mood", "copy", F.md5("lyrics").alias("text_md5"))


@query("balanced_class_sizes", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT lang AS mood, max(n) OVER () AS n FROM c""")
def q_balanced_sizes(spark, sf):
    """M8 invariant: after balancing every class has the size of the largest."""
    d = read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("mood"),
                                                  F.col("text").alias("lyrics"))
    b = S.balance_classes(d, "mood", F.col("doc_id"), None, seed=42)
    return b.groupBy("mood").agg(F.count(F.lit(1)).alias("n"))


@query("downsample_class", """
WITH ranked AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)),
                                                         CAST(doc_id AS VARCHAR)) - 1 AS r,
                       count(*) OVER () AS n FROM documents WHERE lang = 'en')
SELECT doc_id, lang AS mood FROM documents WHERE lang <> 'en'
UNION ALL SELECT doc_id, lang FROM ranked WHERE r < floor(n * 1 / 2)""")
def q_downsample_class(spark, sf):
    """Keep the first half (seeded order) of the largest class."""
    d = read_table(spark, sf, "documents").select("doc_id", F.col("lang").alias("mood"))
    return S.downsample_class(d, "mood", "en", F.col("doc_id"), seed=42)


@query("build_dataset", f"""
WITH base AS (SELECT doc_id, lang AS mood, text, {_WC} AS wordcount FROM documents WHERE length(text) > 0),
codes AS (SELECT mood, CAST(dense_rank() OVER (ORDER BY mood) - 1 AS INTEGER) AS mood_cats FROM (SELECT DISTINCT mood FROM base)),
cut AS (SELECT CAST(floor(quantile_cont(wordcount, 0.75)) AS INTEGER) AS cutoff FROM base),
sp AS (SELECT *, CASE WHEN rk < floor(n_all * 0.8) THEN 'train' WHEN rk < floor(n_all * 0.9) THEN 'dev' ELSE 'test' END AS split
       FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS rk,
                    count(*) OVER () AS n_all FROM base)),
tr AS (SELECT * FROM sp WHERE split = 'train'),
c AS (SELECT mood, count(*) AS n FROM tr GROUP BY mood),
p AS (SELECT mood, CAST(floor((max(n) OVER () - n) / n) AS INTEGER) AS copies,
             max(n) OVER () - n - floor((max(n) OVER () - n) / n) * n AS rest FROM c),
j AS (SELECT tr.*, p.copies, p.rest FROM tr JOIN p ON tr.mood = p.mood),
full_copies AS (SELECT j.*, CAST(g.copy AS INTEGER) AS copy FROM j, LATERAL (SELECT unnest(range(1, j.copies + 1)) AS copy) g WHERE j.copies > 0),
rest AS (SELECT * EXCLUDE (r), copies + 1 AS copy FROM (
           SELECT j.*, row_number() OVER (PARTITION BY mood ORDER BY md5('42|pad|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS r
           FROM j WHERE rest > 0) WHERE r < rest),
copies AS (SELECT doc_id, mood, split, copy,
                  {line_shuffle_sql('text', "(CAST(doc_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR))")} AS text
           FROM (SELECT * FROM full_copies UNION ALL SELECT * FROM rest)),
allrows AS (SELECT doc_id, mood, split, 0 AS copy, text FROM sp
            UNION ALL SELECT doc_id, mood, split, copy, text FROM copies),
tok AS (SELECT a.*, {preprocess_sql('a.text')} AS t FROM allrows a)
SELECT tok.doc_id, tok.mood, codes.mood_cats, tok.split, tok.copy, cut.cutoff,
       CAST(len(t) AS BIGINT) AS n_tokens,
       md5(array_to_string(CASE WHEN len(t) >= cut.cutoff THEN t[1:cut.cutoff]
            ELSE list_concat(t, list_transform(range(cut.cutoff - len(t)), lambda x: '<PAD>')) END, ' ')) AS padded_md5
FROM tok JOIN codes ON tok.mood = codes.mood, cut""")
def q_build_dataset(spark, sf):
    """Filter -> class codes -> cutoff -> exact split -> balance train ->
    tokens padded to the cutoff."""
    lab = labelled_documents(spark, sf).drop("msd_id").withColumnRenamed("doc_id", "msd_id")
    ds = build_dataset(lab, tok="treebank", quadrants=False, balance=True, key="msd_id")
    return ds.select(F.col("msd_id").alias("doc_id"), "mood", "mood_cats", "split", "copy", "cutoff",
                     F.size("tokens").cast("long").alias("n_tokens"),
                     F.md5(F.array_join("tokens_padded", " ")).alias("padded_md5"))
