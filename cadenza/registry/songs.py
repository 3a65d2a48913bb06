"""Index / label / merge / filter queries over song tables (L1-L4 and the
table operators they are made of)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.formatting import percent_text
from cadenza.operators import frames as FR
from cadenza.operators import sampling as S
from cadenza.operators.lexicon import QUADRANT_EXCLUDED, QUADRANT_REWRITES
from cadenza.plans.dataset import filter_songs
from cadenza.plans.index import index_counters, index_songs
from cadenza.plans.label import label_counters, label_songs
from cadenza.registry.base import query
from cadenza.registry.sqlparts import doc_title_sql, file_name_sql, word_count_sql
from cadenza.operators import tags as T
from cadenza.registry.base import values_cte
from cadenza.registry.tagging import MOODS, PROBE, _LABELS
from cadenza.sources.songs import indexed_orders, labelled_documents, lyric_corpus, song_mapping
from cadenza.sources.tables import read_table, tag_store

_FN = file_name_sql("source", doc_title_sql())


def _index_sql(prefix: str | None) -> str:
    scope = f"lower(m.msd_artist) LIKE '{prefix.lower()}%'" if prefix else "TRUE"
    return f"""
WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS msd_id, source AS msd_artist, {doc_title_sql()} AS msd_title,
                  {_FN} AS fn FROM documents),
cs AS (SELECT {_FN} AS fn, coalesce(length(text) > 0, false) AS has_text,
              CASE WHEN length(text) > 0 THEN {word_count_sql('text')} ELSE 0 END AS n_words, lang
       FROM documents),
j AS (SELECT m.*, coalesce(cs.has_text, false) AS found, cs.n_words, cs.lang,
             ({scope}) AND NOT (coalesce(cs.has_text, false) AND cs.lang IS NULL) AS upd
      FROM m LEFT JOIN cs ON m.fn = cs.fn)
SELECT msd_id, msd_artist, msd_title,
  CAST(CASE WHEN upd THEN (CASE WHEN found AND lang = 'en' THEN 1 ELSE 0 END) ELSE -1 END AS INTEGER) AS is_english,
  CAST(CASE WHEN upd THEN (CASE WHEN found THEN 1 ELSE 0 END) ELSE -1 END AS INTEGER) AS lyrics_available,
  CAST(CASE WHEN upd THEN (CASE WHEN found THEN n_words ELSE 0 END) ELSE -1 END AS INTEGER) AS wordcount,
  CASE WHEN upd THEN fn ELSE '-1' END AS lyrics_filename
FROM j"""


@query("index_documents", _index_sql(None))
def q_index_documents(spark, sf):
    """L1 over the whole mapping and corpus."""
    return index_songs(song_mapping(spark, sf), lyric_corpus(spark, sf))


@query("prefix_filter", _index_sql("SRC1"))
def q_prefix_filter(spark, sf):
    """P2 (keep-others form): only artists starting with the prefix are indexed."""
    return index_songs(song_mapping(spark, sf), lyric_corpus(spark, sf), prefix="SRC1")


@query("index_resume", _index_sql(None))
def q_index_resume(spark, sf):
    """P5: a prefix run, then a full run over its output, equals one full run."""
    corpus = lyric_corpus(spark, sf)
    first = index_songs(song_mapping(spark, sf), corpus, prefix="src1")
    return index_songs(first, corpus)


@query("run_counters", """
WITH r AS (""" + _index_sql("src1") + """)
SELECT count(*) FILTER (WHERE lyrics_available >= 0) AS processed,
       count(*) FILTER (WHERE lyrics_available = 1 AND is_english = 0) AS not_english,
       count(*) FILTER (WHERE lyrics_available = 0) AS no_lyrics,
       count(*) FILTER (WHERE lyrics_available = 1 AND is_english = 1) AS ready,
       count(*) FILTER (WHERE lyrics_available < 0) AS unprocessed
FROM r""")
def q_run_counters(spark, sf):
    """One aggregate of count_if over an index run."""
    idx = index_songs(song_mapping(spark, sf), lyric_corpus(spark, sf), prefix="src1")
    return index_counters(idx)


_SONGS_SQL = """songs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS msd_id, 'artist ' || CAST(o_custkey AS VARCHAR) AS msd_artist,
         'title ' || CAST(o_orderkey AS VARCHAR) AS msd_title,
         CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS is_english,
         CASE WHEN o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END AS lyrics_available
  FROM orders)"""


def _label_sql(prefix: str | None = None) -> str:
    where = f"WHERE lower(s.msd_artist) LIKE '{prefix.lower()}%'" if prefix else ""
    el = "(s.is_english = 1 AND s.lyrics_available = 1)"
    scores = ",\n".join(f"CASE WHEN {el} THEN CAST(coalesce(l.{m}, 0) AS BIGINT) END AS {m}" for m in MOODS)
    return "WITH " + _LABELS + ",\n" + _SONGS_SQL + f"""
SELECT s.msd_id, s.msd_artist, s.msd_title, s.is_english, s.lyrics_available,
  CASE WHEN {el} THEN coalesce(l.mood, 'unknown') ELSE '' END AS mood,
  CAST(CASE WHEN {el} THEN coalesce(l.found_tags, 0) ELSE -1 END AS INTEGER) AS found_tags,
  CAST(CASE WHEN {el} THEN coalesce(l.matched_mood, 0) ELSE -1 END AS INTEGER) AS matched_mood,
  {scores}
FROM songs s LEFT JOIN labels l ON s.msd_id = l.tid {where}"""


@query("label_documents", _label_sql())
def q_label_documents(spark, sf):
    """L2 (expanded mode) over every indexed song."""
    return label_songs(indexed_orders(spark, sf), tag_store(spark, sf), PROBE, "expanded")


@query("keep_drop_merge", _label_sql("artist 1"))
def q_keep_drop_merge(spark, sf):
    """P2 (dropping form) + P3/P4 + U1: only eligible rows are labelled, the
    rest come back with '' / -1 / NULL scores."""
    return label_songs(indexed_orders(spark, sf), tag_store(spark, sf), PROBE, "expanded",
                       prefix="artist 1")


@query("label_counters", "WITH lab AS (" + _label_sql() + """)
SELECT count(*) FILTER (WHERE found_tags >= 0) AS processed,
       count(*) FILTER (WHERE found_tags > 0) AS with_tags,
       count(*) FILTER (WHERE found_tags > 0 AND matched_mood = 0) AS no_match,
       count(*) FILTER (WHERE matched_mood = 1) AS labelled
FROM lab""")
def q_label_counters(spark, sf):
    """A16 for the label run."""
    lab = label_songs(indexed_orders(spark, sf), tag_store(spark, sf), PROBE, "expanded")
    return label_counters(lab)


def _quadrant_sql_expr(col: str) -> str:
    e = col
    for quad, moods in QUADRANT_REWRITES:
        for m in moods:
            e = f"replace({e}, '{m}', '{quad}')"
    return e


@query("quadrant_filter", "WITH lab AS (" + _label_sql() + f"""),
f AS (SELECT msd_id, msd_artist, msd_title, {_quadrant_sql_expr('mood')} AS mood
      FROM lab WHERE is_english = 1 AND lyrics_available = 1 AND matched_mood = 1)
SELECT * FROM f WHERE NOT ({' OR '.join(f"contains(mood, '{m}')" for m in QUADRANT_EXCLUDED)})""")
def q_quadrant_filter(spark, sf):
    """L4: flag cascade, drop the flags, fold moods into quadrants, drop the
    excluded moods."""
    lab = label_songs(indexed_orders(spark, sf), tag_store(spark, sf), PROBE, "expanded")
    lab = lab.select("msd_id", "msd_artist", "msd_title", "is_english", "lyrics_available",
                     "matched_mood", "mood")
    return filter_songs(lab, drop=True, quadrants=True)


@query("genre_left_join", f"""
WITH g AS (SELECT CAST(doc_id AS VARCHAR) AS msd_id,
                  'genre_' || CAST(quality AS VARCHAR) || '_' || CAST(toxic AS VARCHAR) AS magd_genre
           FROM labels)
SELECT CAST(d.doc_id AS VARCHAR) AS msd_id, d.source AS msd_artist, d.lang AS mood, g.magd_genre
FROM documents d LEFT JOIN g ON CAST(d.doc_id AS VARCHAR) = g.msd_id""")
def q_genre_left_join(spark, sf):
    """Songs left join genre; duplicate genre keys would multiply rows."""
    songs = labelled_documents(spark, sf).select("msd_id", "msd_artist", "mood")
    genre = read_table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("msd_id"),
        F.concat(F.lit("genre_"), F.col("quality").cast("string"), F.lit("_"),
                 F.col("toxic").cast("string")).alias("magd_genre"))
    return songs.join(genre, "msd_id", "left")


@query("class_codes", """
WITH c AS (SELECT mood, CAST(dense_rank() OVER (ORDER BY mood) - 1 AS INTEGER) AS label_code
           FROM (SELECT DISTINCT lang AS mood FROM documents WHERE lang IS NOT NULL))
SELECT d.doc_id, d.lang AS mood, coalesce(c.label_code, -1) AS label_code
FROM documents d LEFT JOIN c ON d.lang = c.mood""")
def q_class_codes(spark, sf):
    """Sorted distinct labels -> 0..K-1."""
    df = labelled_documents(spark, sf).select("doc_id", "mood")
    return S.class_codes(df, "mood")


@query("class_counts", "SELECT lang AS mood, count(*) AS n FROM documents GROUP BY lang")
def q_class_counts(spark, sf):
    """Rows per class."""
    return FR.class_counts(labelled_documents(spark, sf), "mood")


@query("largest_class", """
SELECT max(n) AS largest FROM (SELECT lang, count(doc_id) AS n FROM documents GROUP BY lang)""")
def q_largest_class(spark, sf):
    """A10: size of the largest class (non-null ids)."""
    df = labelled_documents(spark, sf)
    return (df.groupBy("mood").agg(F.count("msd_id").alias("n"))
            .agg(F.max("n").alias("largest")))


_SPLIT_SQL = """split AS (
  SELECT *, CASE WHEN rk < floor(n_all * 0.8) THEN 'train'
                 WHEN rk < floor(n_all * 0.9) THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS rk,
               count(*) OVER () AS n_all FROM documents))"""


@query("majority_baseline", "WITH " + _SPLIT_SQL + """,
c AS (SELECT split, lang AS mood, count(*) AS n FROM split GROUP BY split, lang),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, mood) AS rn,
             sum(n) OVER (PARTITION BY split) AS total FROM c)
SELECT split, mood AS majority, n, CAST(total AS BIGINT) AS total, round(n / total, 5) AS share,
       printf('%.2f%%', round_even(n / total * 100, 2)) AS share_text
FROM r WHERE rn = 1""")
def q_majority_baseline(spark, sf):
    """A11 + F15: majority class per split and its share."""
    df = labelled_documents(spark, sf)
    sp = S.three_way_split(df, F.col("doc_id"), seed=42)
    c = sp.groupBy("split", "mood").agg(F.count(F.lit(1)).alias("n"))
    per = c.groupBy("split").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), "mood", "n")).alias("top"),
        F.sum("n").alias("total"))
    return _majority(per)


def _majority(per):
    return per.select(
        "split", F.col("top.mood").alias("majority"), F.col("top.n").alias("n"),
        F.col("total").cast("long").alias("total"),
        F.round(F.col("top.n") / F.col("total"), 5).alias("share"),
        percent_text(F.col("top.n") / F.col("total")).alias("share_text"))


@query("mood_selection", "WITH lab AS (" + _label_sql() + ")\nSELECT msd_id, mood FROM lab WHERE mood = 'calm'")
def q_mood_selection(spark, sf):
    """Equality selection on the label."""
    lab = label_songs(indexed_orders(spark, sf), tag_store(spark, sf), PROBE, "expanded")
    return lab.where(F.col("mood") == "calm").select("msd_id", "mood")


@query("sorted_index", _index_sql(None))
def q_sorted_index(spark, sf):
    """The index globally ordered by artist (range-partitioned sort)."""
    idx = index_songs(song_mapping(spark, sf), lyric_corpus(spark, sf))
    return idx.orderBy("msd_artist", "msd_id")


@query("dataset_equality", "SELECT CAST(0 AS BIGINT) AS n_left_only, CAST(0 AS BIGINT) AS n_right_only")
def q_dataset_equality(spark, sf):
    """U4: a resumed index equals a one-shot index (bag equality both ways)."""
    corpus = lyric_corpus(spark, sf)
    once = index_songs(song_mapping(spark, sf), corpus)
    resumed = index_songs(index_songs(song_mapping(spark, sf), corpus, prefix="src1"), corpus)
    return FR.frames_equal(once, resumed)


_LEX_EXPAND_SQL = values_cte(
    "terms", ["mood", "n_exact", "n_like", "n_filter"],
    [(m, len(PROBE.exact[m]), len(PROBE.like.get(m, [])), len(PROBE.filters.get(m, [])))
     for m in PROBE.moods_sorted]) + """,
exact_terms AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{m}', '{t}')" for m in PROBE.moods_sorted for t in PROBE.exact[m]) + """) t(mood, term)),
ex AS (SELECT e.mood, count(DISTINCT li.l_orderkey) AS exact_songs
       FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey JOIN part p ON li.l_partkey = p.p_partkey
       JOIN exact_terms e ON p.p_name = e.term GROUP BY e.mood),
lb AS (SELECT mood, count(*) AS labelled_songs FROM lab WHERE matched_mood = 1 GROUP BY mood)
SELECT t.mood, CAST(t.n_exact AS INTEGER) AS n_exact, CAST(t.n_like AS INTEGER) AS n_like,
       CAST(t.n_filter AS INTEGER) AS n_filter, coalesce(ex.exact_songs, 0) AS exact_songs,
       coalesce(lb.labelled_songs, 0) AS labelled_songs
FROM terms t LEFT JOIN ex ON t.mood = ex.mood LEFT JOIN lb ON t.mood = lb.mood"""


@query("lexicon_expand", "WITH lab AS (" + _label_sql() + "), " + _LEX_EXPAND_SQL)
def q_lexicon_expand(spark, sf):
    """Per mood the size of the exact / like / filter lists, the songs the
    exact lists reach, and the songs labelled with the expanded lexicon."""
    store = tag_store(spark, sf)
    lab = label_songs(indexed_orders(spark, sf), store, PROBE, "expanded")
    terms = spark.createDataFrame(
        [(m, len(PROBE.exact[m]), len(PROBE.like.get(m, [])), len(PROBE.filters.get(m, [])))
         for m in PROBE.moods_sorted], "mood string, n_exact int, n_like int, n_filter int")
    exact_songs = (T.exact_match_rows(store, PROBE).groupBy("mood")
                   .agg(F.countDistinct("tid_id").alias("exact_songs")))
    labelled = lab.where(F.col("matched_mood") == 1).groupBy("mood").agg(
        F.count(F.lit(1)).alias("labelled_songs"))
    return (terms.join(exact_songs, "mood", "left").join(labelled, "mood", "left")
            .na.fill(0, ["exact_songs", "labelled_songs"]))
