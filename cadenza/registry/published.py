"""The published 18-mood lexicon end to end (L2 both modes, L4, S11, L9): tags
are the words and word pairs of ``documents``, so its like and filter
terms really hit; and small operators that had no query of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as TX
from cadenza.functions.formatting import run_key
from cadenza.operators import frames as FR
from cadenza.operators import lookups as LK
from cadenza.operators import tags as T
from cadenza.operators.lexicon import QUADRANT_EXCLUDED, QUADRANT_REWRITES, Lexicon, full_lexicon, lexicon_from_json_column
from cadenza.plans.dataset import filter_songs
from cadenza.plans.label import label_songs
from cadenza.registry.base import query
from cadenza.registry.sqlparts import BLANKS_SQL, word_count_sql
from cadenza.registry.tagging import _lex_ctes
from cadenza.session import scratch_path
from cadenza.sources import sinks as SK
from cadenza.sources.tables import TagStore, read_table

FULL = full_lexicon()
MOODS = FULL.moods_sorted


def word_tags(spark, sf) -> TagStore:
    """Tag store over ``documents``: every lower-cased word and pair of neighbouring words of a text is a tag of it.

    Nothing is stored or shuffled but what a caller asks for. A word never equals a pair, so a text's tags are
    counted inside its row; only texts that share their id are counted by rows."""
    d = read_table(spark, sf, "documents").select("doc_id", TX.whitespace_tokens(F.lower("text")).alias("w"))
    single = F.transform("w", lambda x, i: F.struct(i.alias("pos"), F.lit(1).alias("words"), x.alias("tag")))
    pair = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(
        i.alias("pos"), F.lit(2).alias("words"), F.concat_ws(" ", x, F.get("w", i + 1)).alias("tag")))

    def rows(keep, whole=None) -> DataFrame:
        texts = d.where(whole(F.array_join("w", " "))) if whole else d
        hits = texts.select("doc_id", F.inline(F.concat(single, pair))).where(keep(F.col("tag")))
        hits = hits.groupBy("doc_id", "tag").agg(F.min(F.struct("pos", "words")).alias("tag_ord"))
        return hits.select(F.col("doc_id").alias("tid_id"), F.col("tag").alias("tag_id"), F.lit(1.0).alias("val"), "tag_ord")

    distinct = [F.coalesce(F.size(F.array_distinct(F.transform(x, lambda t: t["tag"]))), F.lit(0)) for x in (single, pair)]
    counted = d.select("doc_id", (distinct[0] + distinct[1]).cast("long").alias("n")).where("doc_id IS NOT NULL")
    per_id = SK.materialise(counted.groupBy("doc_id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("texts")), "tag-counts")
    shared = d.join(per_id.where("texts > 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.inline(F.concat(single, pair)))
    found = (per_id.where("texts = 1").select(F.col("doc_id").alias("tid_id"), F.col("n").alias("found_tags"))
             .unionByName(shared.groupBy(F.col("doc_id").alias("tid_id")).agg(F.count_distinct("tag").alias("found_tags"))))
    every = rows(lambda tag: F.lit(True))  # a text is its own id
    return TagStore(d.select(F.col("doc_id").alias("tid_id"), F.col("doc_id").cast("string").alias("tid")),
                    every.select("tag_id", F.col("tag_id").alias("tag")).distinct(), every, found.where("found_tags > 0"), rows)


def _songs(spark, sf):
    return read_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("msd_id"), F.col("source").alias("msd_artist"),
        F.when(F.col("lang") == "en", 1).otherwise(0).alias("is_english"),
        F.when(F.length("text") > 0, 1).otherwise(0).alias("lyrics_available"))


_ROWS = _lex_ctes(FULL) + f""",
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{BLANKS_SQL}'), lambda x: x <> '') AS w FROM documents),
flat AS (SELECT doc_id, unnest(w) AS tag, generate_subscripts(w, 1) AS pos, 1 AS words FROM w
         UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
                          unnest(range(1, len(w))), 2 FROM w),
rows AS (SELECT doc_id AS tid_id, tag, min({{'pos': pos, 'words': words}}) AS tag_ord FROM flat GROUP BY 1, 2),
found AS (SELECT tid_id, count(*) AS n FROM rows GROUP BY 1)"""

_FULL_LABELS = "WITH " + _ROWS + f""",
texts AS (SELECT DISTINCT tag FROM rows),
hits AS (SELECT t.tag, l.mood, count(*) AS n_like FROM texts t JOIN lex_like l ON position(l.term IN t.tag) > 0 GROUP BY 1, 2),
fh AS (SELECT h.tag, h.mood, sum((length(h.tag) - length(replace(h.tag, f.term, ''))) // length(f.term)) AS n
       FROM hits h JOIN lex_filter f ON h.mood = f.mood GROUP BY 1, 2),
dl AS (SELECT h.tag, h.mood, h.n_like * (1 - coalesce(fh.n, 0)) AS delta
       FROM hits h LEFT JOIN fh ON h.tag = fh.tag AND h.mood = fh.mood),
board AS (SELECT r.tid_id, d.mood, sum(d.delta) AS score FROM rows r JOIN dl d ON r.tag = d.tag GROUP BY 1, 2),
best AS (SELECT tid_id, mood FROM (SELECT *, row_number() OVER (PARTITION BY tid_id ORDER BY score DESC, mood) AS rn FROM board)
         WHERE rn = 1 AND score > 0),
wide AS (SELECT tid_id, {", ".join(f"sum(CASE WHEN mood = '{m}' THEN score END) AS {m}" for m in MOODS)} FROM board GROUP BY 1),
labels AS (SELECT d.doc_id AS tid_id, CAST(coalesce(f.n, 0) AS INTEGER) AS found_tags,
                  CASE WHEN b.mood IS NOT NULL THEN 1 ELSE 0 END AS matched_mood, coalesce(b.mood, 'unknown') AS mood,
                  {", ".join(f"CAST(coalesce(w.{m}, 0) AS BIGINT) AS {m}" for m in MOODS)}
           FROM documents d LEFT JOIN found f ON d.doc_id = f.tid_id LEFT JOIN best b ON d.doc_id = b.tid_id
           LEFT JOIN wide w ON d.doc_id = w.tid_id)"""


@query("label_full_lexicon", _FULL_LABELS + "\nSELECT * FROM labels")
def q_label_full_lexicon(spark, sf):
    """L2 (expanded mode) with the published lexicon: 18 score columns."""
    return T.label_expanded(word_tags(spark, sf), FULL).drop("tid")


@query("label_exact_mode", "WITH " + _ROWS + """,
firsts AS (SELECT tid_id, mood FROM (
  SELECT r.tid_id, e.mood, row_number() OVER (PARTITION BY r.tid_id ORDER BY r.tag_ord, e.mood_ord) AS rn
  FROM rows r JOIN lex_exact e ON r.tag = e.term) WHERE rn = 1)
SELECT CAST(d.doc_id AS VARCHAR) AS msd_id,
       CASE WHEN d.lang = 'en' AND length(d.text) > 0 THEN coalesce(x.mood, 'unknown') ELSE '' END AS mood,
       CAST(CASE WHEN d.lang = 'en' AND length(d.text) > 0 THEN coalesce(f.n, 0) ELSE -1 END AS INTEGER) AS found_tags,
       CAST(CASE WHEN d.lang = 'en' AND length(d.text) > 0 THEN CAST(x.mood IS NOT NULL AS INTEGER) ELSE -1 END AS INTEGER)
         AS matched_mood
FROM documents d LEFT JOIN found f ON d.doc_id = f.tid_id LEFT JOIN firsts x ON d.doc_id = x.tid_id""")
def q_label_exact_mode(spark, sf):
    """L2 (exact mode) with the published lexicon: the first exact tag decides."""
    out = label_songs(_songs(spark, sf), word_tags(spark, sf), FULL, "exact")
    return out.select("msd_id", "mood", "found_tags", "matched_mood")


def _folded(col: str) -> str:
    for quad, moods in QUADRANT_REWRITES:
        for m in moods:
            col = f"replace({col}, '{m}', '{quad}')"
    return col


@query("quadrant_full", _FULL_LABELS + f""",
q AS (SELECT CAST(d.doc_id AS VARCHAR) AS msd_id, {_folded('l.mood')} AS mood FROM documents d JOIN labels l ON d.doc_id = l.tid_id
      WHERE d.lang = 'en' AND length(d.text) > 0 AND l.matched_mood = 1)
SELECT * FROM q WHERE NOT ({" OR ".join(f"contains(mood, '{m}')" for m in QUADRANT_EXCLUDED)})""")
def q_quadrant_full(spark, sf):
    """L4 on the published moods: flags, fold into quadrants (F9), drop the excluded moods."""
    lab = label_songs(_songs(spark, sf), word_tags(spark, sf), FULL, "expanded")
    return filter_songs(lab.select("msd_id", "is_english", "lyrics_available", "matched_mood", "mood"))


def reload_lexicon(spark, path: str) -> Lexicon:
    """A stored lexicon document back as a Lexicon (its terms are few by nature)."""
    rows = lexicon_from_json_column(spark.read.text(path, wholetext=True)).orderBy("kind", "mood", "term_ord").collect()
    kinds = [{}, {}, {}]
    for r in rows:
        kinds[r["kind"]].setdefault(r["mood"], []).append(r["term"])
    return Lexicon(*kinds)


@query("lexicon_roundtrip", _FULL_LABELS + f""",
ex AS (SELECT e.mood, count(DISTINCT r.tid_id) AS n FROM rows r JOIN lex_exact e ON r.tag = e.term GROUP BY 1),
lb AS (SELECT mood, count(*) AS n FROM labels WHERE matched_mood = 1 GROUP BY 1),
n AS (SELECT mood, sum(e) AS n_exact, sum(l) AS n_like, sum(f) AS n_filter FROM (
        SELECT mood, 1 AS e, 0 AS l, 0 AS f FROM lex_exact UNION ALL SELECT mood, 0, 1, 0 FROM lex_like
        UNION ALL SELECT mood, 0, 0, 1 FROM lex_filter) GROUP BY 1)
SELECT n.mood, n.n_exact, n.n_like, n.n_filter, coalesce(ex.n, 0) AS exact_songs, coalesce(lb.n, 0) AS labelled_songs
FROM n LEFT JOIN ex ON n.mood = ex.mood LEFT JOIN lb ON n.mood = lb.mood""")
def q_lexicon_roundtrip(spark, sf):
    """S11 + L9: the expanded lexicon is written, read back and applied; per
    mood its terms, the songs its exact terms reach and those it labels."""
    path = scratch_path(spark, "queries", "lexicon", uuid.uuid4().hex)
    spark.createDataFrame([(FULL.to_json(),)], "value string").coalesce(1).write.text(path)
    terms = lexicon_from_json_column(spark.read.text(path, wholetext=True))
    names = ("n_exact", "n_like", "n_filter", "exact_songs", "labelled_songs")

    def counted(df, **cols):
        return df.select("mood", *[cols.get(c, F.lit(0)).cast("long").alias(c) for c in names])

    sizes = counted(terms, **{c: (F.col("kind") == i).cast("long") for i, c in enumerate(names[:3])})
    lex, store = reload_lexicon(spark, path), word_tags(spark, sf)
    exact = counted(T.exact_match_rows(store, lex).select("mood", "tid_id").distinct(), exact_songs=F.lit(1))
    lab = counted(T.label_expanded(store, lex).where("matched_mood = 1"), labelled_songs=F.lit(1))
    return FR.union_by_name(sizes, exact, lab).groupBy("mood").agg(*[F.sum(c).alias(c) for c in names])


# ---------------------------------------------------------------- small operators


@query("run_keys", """
SELECT p_partkey, 'Em-' || (p_size * 10) || '_FS-3-4-' || (p_size % 7) || '_NF-128_D-0.5_L2-0.01_B-' || (p_size + 1) ||
       '_Ep-' || p_partkey || '_W2V-' || (p_size % 2) || '_V-50000_' || p_brand AS run_key FROM part""")
def q_run_keys(spark, sf):
    """F16: the run key of a table of options."""
    size = F.col("p_size")
    return read_table(spark, sf, "part").select("p_partkey", run_key(
        size * 10, F.array(F.lit(3), F.lit(4), size % 7), F.lit(128), F.lit(0.5), F.lit(0.01), size + 1, F.col("p_partkey"),
        size % 2, F.lit(50000), F.col("p_brand")).alias("run_key"))


@query("overwrite_guard", "SELECT l_returnflag, count(*) AS n, TRUE AS refused FROM lineitem GROUP BY 1")
def q_overwrite_guard(spark, sf):
    """A second write to the same place is refused and changes nothing."""
    path = scratch_path(spark, "queries", "guard", uuid.uuid4().hex)
    flags = read_table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    SK.write_table(flags, path)
    refused = False
    try:
        SK.write_table(flags.limit(0), path)
    except Exception as e:  # noqa: BLE001 - Spark wraps the reason
        refused = "ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query("union_by_name", """
SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def q_union_by_name(spark, sf):
    """Columns aligned by name, the missing one NULL."""
    s = read_table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                                 F.col("c_mktsegment").alias("segment"))
    return FR.union_by_name(s, c)


@query("present_files", """
SELECT doc_id, 'f' || (doc_id % 50) AS lyrics_filename FROM documents
WHERE 'f' || (doc_id % 50) IN (SELECT 'f' || (page_id % 70) FROM pages WHERE page_id % 3 = 0)""")
def q_present_files(spark, sf):
    """J12, semi form: songs whose file is in the listing; a name listed twice doubles nothing."""
    songs = read_table(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string"))
                                                      .alias("lyrics_filename"))
    listing = read_table(spark, sf, "pages").where("page_id % 3 = 0").select(
        F.concat(F.lit("f"), (F.col("page_id") % 70).cast("string")).alias("lyrics_filename"))
    return LK.present_files(songs, listing)


@query("tokens_whitespace", f"""
SELECT doc_id, {word_count_sql('text')} AS n_tokens,
       array_to_string(list_filter(regexp_split_to_array(lower(text), '{BLANKS_SQL}'), lambda x: x <> ''), ' ') AS tokens_text
FROM documents""")
def q_tokens_whitespace(spark, sf):
    """X1, id 0: white-space tokens."""
    t = TX.preprocess(F.col("text"), 0, remove_stop=False, remove_punc=False)
    return read_table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens_text"))


@query("tokens_custom", "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]{4,}'), ' ') AS tokens_text FROM documents")
def q_tokens_custom(spark, sf):
    """X1 with the caller's own tokeniser: a function from Column to Column."""
    t = TX.preprocess(F.col("text"), lambda c: F.regexp_extract_all(c, F.lit("[a-z]{4,}"), 0), False, False)
    return read_table(spark, sf, "documents").select("doc_id", F.array_join(t, " ").alias("tokens_text"))


@query("song_lookup_quoted", """
SELECT CAST(l_orderkey AS VARCHAR) AS tid, p_name || '''s "x"' AS tag, l_quantity AS val
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_name = 'red bolt'""")
def q_song_lookup_quoted(spark, sf):
    """A tag with quotes is a value, never SQL text."""
    from cadenza.sources.tables import tag_store

    s = tag_store(spark, sf)
    quoted = TagStore(s.tids, s.tags.withColumn("tag", F.concat("tag", F.lit("'s \"x\""))), s.tid_tag)
    return T.songs_for_tag(quoted, "red bolt's \"x\"").select("tid", "tag", "val")


@query("frames_differ", """
SELECT count(*) FILTER (WHERE l_orderkey % 1000 = 7) + count(*) FILTER (WHERE l_orderkey % 1000 = 13) AS n_left_only,
       count(*) FILTER (WHERE l_orderkey % 1000 IN (7, 11)) + count(*) FILTER (WHERE l_orderkey % 1000 = 17) AS n_right_only FROM lineitem""")
def q_frames_differ(spark, sf):
    """U4 on two versions of the tag rows with known differences: changed rows, rows that one side lacks, and rows that
    one side holds twice. Only the differing ranges of hashes are shuffled."""
    right = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    k = F.col("l_orderkey") % 1000
    left = right.where(k != 11).withColumn("l_quantity", F.when(k == 7, -F.col("l_quantity")).otherwise(F.col("l_quantity")))
    left = left.unionByName(right.where(k == 13))
    return FR.frames_equal(left, right.unionByName(right.where(k == 17)))
