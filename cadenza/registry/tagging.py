"""Tag-algebra queries over the driver tables (orders = songs, lineitem =
song tags, part names = tag texts) with a probe lexicon that hits them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import tags as T
from cadenza.operators.lexicon import Lexicon
from cadenza.registry.base import query, values_cte
from cadenza.sources.tables import tag_store

# Probe lexicon over the part-name vocabulary ({colour/size} x {object}).
# One filter term ('r') also sits inside a like hit, so scores reach 0 and
# below, as with the published lexicon.
PROBE = Lexicon(
    exact={
        "anger": ["red widget", "red bolt", "hot rod"],
        "calm": ["blue plate", "old anvil", "cold gear"],
        "happy": ["new gizmo", "hot gear", "small widget"],
    },
    like={"anger": ["r", "red"], "calm": ["blu", "old"], "happy": ["gi", "hot"]},
    filters={"anger": ["ring", "large", "r"], "calm": ["cold"], "happy": ["gizmo"]},
)
MOODS = PROBE.moods_sorted


def _lex_ctes(lex: Lexicon = PROBE) -> str:
    likes = [(m, i + 1, t) for i, m in enumerate(lex.moods_sorted) for t in lex.like.get(m, [])]
    filt = [(m, t) for m in lex.moods_sorted for t in lex.filters.get(m, [])]
    exact = [(m, i + 1, t) for i, m in enumerate(lex.moods_exact_order) for t in lex.exact[m]]
    return ",\n".join([
        values_cte("lex_like", ["mood", "mood_ord", "term"], likes),
        values_cte("lex_filter", ["mood", "term"], filt),
        values_cte("lex_exact", ["mood", "mood_ord", "term"], exact),
    ])


# tag rows = tids |><| tid_tag |><| tags, and per-tag-text deltas
_BASE = _lex_ctes() + """,
rows AS (
  SELECT li.l_orderkey AS tid_id, CAST(o.o_orderkey AS VARCHAR) AS tid, li.l_partkey AS tag_id,
         p.p_name AS tag, li.l_quantity AS val, li.l_linenumber AS line
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
  JOIN part p ON li.l_partkey = p.p_partkey),
texts AS (SELECT DISTINCT p_name AS tag FROM part),
hits AS (SELECT t.tag, l.mood, l.mood_ord, count(*) AS n_like
         FROM texts t JOIN lex_like l ON position(l.term IN t.tag) > 0
         GROUP BY t.tag, l.mood, l.mood_ord),
fhits AS (SELECT h.tag, h.mood,
                 sum((length(h.tag) - length(replace(h.tag, f.term, ''))) // length(f.term)) AS n_filter
          FROM hits h JOIN lex_filter f ON h.mood = f.mood GROUP BY h.tag, h.mood),
deltas AS (SELECT h.tag, h.mood, h.mood_ord, h.n_like * (1 - coalesce(f.n_filter, 0)) AS delta
           FROM hits h LEFT JOIN fhits f ON h.tag = f.tag AND h.mood = f.mood),
board AS (SELECT r.tid_id, d.mood, d.mood_ord, CAST(sum(d.delta) AS BIGINT) AS score
          FROM rows r JOIN deltas d ON r.tag = d.tag GROUP BY r.tid_id, d.mood, d.mood_ord)"""

_SCORE_COLS = ",\n".join(
    f"CAST(coalesce(sum(CASE WHEN b.mood = '{m}' THEN b.score END), 0) AS BIGINT) AS {m}"
    for m in MOODS)

_LABELS = _BASE + f""",
found AS (SELECT tid_id, count(*) AS found_tags FROM rows GROUP BY tid_id),
wide AS (SELECT b.tid_id, {_SCORE_COLS} FROM board b GROUP BY b.tid_id),
best AS (SELECT tid_id, mood FROM (
           SELECT tid_id, mood, score,
                  row_number() OVER (PARTITION BY tid_id ORDER BY score DESC, mood) AS rn
           FROM board) WHERE rn = 1 AND score > 0),
labels AS (
  SELECT o.o_orderkey AS tid_id, CAST(o.o_orderkey AS VARCHAR) AS tid,
         CAST(coalesce(f.found_tags, 0) AS INTEGER) AS found_tags,
         CASE WHEN bt.mood IS NOT NULL THEN 1 ELSE 0 END AS matched_mood,
         coalesce(bt.mood, 'unknown') AS mood,
         {", ".join(f"CAST(coalesce(w.{m}, 0) AS BIGINT) AS {m}" for m in MOODS)}
  FROM orders o LEFT JOIN found f ON o.o_orderkey = f.tid_id
  LEFT JOIN wide w ON o.o_orderkey = w.tid_id
  LEFT JOIN best bt ON o.o_orderkey = bt.tid_id)"""


@query("tag_scoreboard", "WITH " + _BASE + "\nSELECT tid_id, mood, score FROM board")
def q_tag_scoreboard(spark, sf):
    return T.scoreboard_long(tag_store(spark, sf), PROBE)


@query("tag_scoreboard_winner", "WITH " + _LABELS +
       "\nSELECT tid_id, found_tags, matched_mood, mood FROM labels")
def q_tag_scoreboard_winner(spark, sf):
    return T.label_expanded(tag_store(spark, sf), PROBE).select(
        "tid_id", "found_tags", "matched_mood", "mood")


@query("tag_scoreboard_pivot", "WITH " + _LABELS + "\nSELECT * FROM labels")
def q_tag_scoreboard_pivot(spark, sf):
    return T.label_expanded(tag_store(spark, sf), PROBE)


@query("exact_mood_first_tag", "WITH " + _BASE + """,
found AS (SELECT tid_id, count(*) AS n FROM rows GROUP BY tid_id),
tag_mood AS (SELECT tag, mood, mood_ord FROM (
  SELECT p.p_name AS tag, e.mood, e.mood_ord,
         row_number() OVER (PARTITION BY p.p_name ORDER BY e.mood_ord) AS rn
  FROM (SELECT DISTINCT p_name FROM part) p JOIN lex_exact e ON p.p_name = e.term) WHERE rn = 1),
firsts AS (SELECT tid_id, mood FROM (
  SELECT r.tid_id, t.mood,
         row_number() OVER (PARTITION BY r.tid_id ORDER BY r.line, r.tag_id, t.mood_ord) AS rn
  FROM rows r JOIN tag_mood t ON r.tag = t.tag) WHERE rn = 1)
SELECT o.o_orderkey AS tid_id, CAST(o.o_orderkey AS VARCHAR) AS tid,
       CAST(coalesce(f.n, 0) AS INTEGER) AS found_tags,
       CASE WHEN fi.mood IS NOT NULL THEN 1 ELSE 0 END AS matched_mood,
       coalesce(fi.mood, 'unknown') AS mood
FROM orders o LEFT JOIN found f ON o.o_orderkey = f.tid_id
LEFT JOIN firsts fi ON o.o_orderkey = fi.tid_id""")
def q_exact_mood_first_tag(spark, sf):
    return T.label_exact(tag_store(spark, sf), PROBE)


@query("tags_per_song", """
SELECT o.o_orderkey AS tid_id, CAST(count(li.l_orderkey) AS BIGINT) AS found_tags
FROM orders o LEFT JOIN lineitem li ON o.o_orderkey = li.l_orderkey GROUP BY o.o_orderkey""")
def q_tags_per_song(spark, sf):
    return T.tags_per_song(tag_store(spark, sf))


@query("songs_per_tag", """
SELECT p.p_name AS tag, count(o.o_orderkey) AS n_songs
FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey JOIN part p ON li.l_partkey = p.p_partkey
GROUP BY p.p_name""")
def q_songs_per_tag(spark, sf):
    return T.songs_per_tag(tag_store(spark, sf))


@query("top_tags", """
SELECT p.p_name AS tag, count(o.o_orderkey) AS n_songs
FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey JOIN part p ON li.l_partkey = p.p_partkey
GROUP BY p.p_name ORDER BY n_songs DESC, tag LIMIT 20""")
def q_top_tags(spark, sf):
    """Head-n of an ordered result (a top-k, TakeOrderedAndProject)."""
    return T.songs_per_tag(tag_store(spark, sf)).orderBy(F.desc("n_songs"), "tag").limit(20)


@query("tag_lookup", """
SELECT li.l_orderkey AS tid_id, CAST(li.l_orderkey AS VARCHAR) AS tid, p.p_name AS tag, li.l_quantity AS val
FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey JOIN part p ON li.l_partkey = p.p_partkey
WHERE p.p_name = 'red widget'""")
def q_tag_lookup(spark, sf):
    return T.songs_for_tag(tag_store(spark, sf), "red widget")


@query("song_lookup", """
SELECT li.l_orderkey AS tid_id, CAST(li.l_orderkey AS VARCHAR) AS tid, p.p_name AS tag, li.l_quantity AS val
FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey JOIN part p ON li.l_partkey = p.p_partkey
WHERE CAST(li.l_orderkey AS VARCHAR) = '7'""")
def q_song_lookup(spark, sf):
    return T.tags_for_song(tag_store(spark, sf), "7")


_EXACT_ROWS = """exact_rows AS (
  SELECT e.mood, r.tid_id, r.tag_id, r.tag FROM rows r
  JOIN (SELECT DISTINCT mood, term FROM lex_exact) e ON r.tag = e.term)"""
_LIKE_ROWS = """like_rows AS (
  SELECT m.mood, r.tid_id, r.tag_id, r.tag FROM rows r
  JOIN (SELECT DISTINCT t.tag, l.mood FROM texts t JOIN lex_like l
        ON position(lower(l.term) IN lower(t.tag)) > 0) m ON r.tag = m.tag),
like_kept AS (
  SELECT * FROM like_rows lr WHERE NOT EXISTS (
    SELECT 1 FROM lex_filter f WHERE f.mood = lr.mood AND position(f.term IN lower(lr.tag)) > 0))"""


@query("exact_tag_match", "WITH " + _BASE + ",\n" + _EXACT_ROWS +
       "\nSELECT mood, tid_id, tag_id, tag FROM exact_rows")
def q_exact_tag_match(spark, sf):
    return T.exact_match_rows(tag_store(spark, sf), PROBE)


@query("like_tag_match", "WITH " + _BASE + ",\n" + _LIKE_ROWS +
       "\nSELECT mood, tid_id, tag_id, tag FROM like_rows")
def q_like_tag_match(spark, sf):
    return T.like_match_rows(tag_store(spark, sf), PROBE)


@query("like_tag_match_filtered", "WITH " + _BASE + ",\n" + _LIKE_ROWS +
       "\nSELECT mood, tid_id, tag_id, tag FROM like_kept")
def q_like_tag_match_filtered(spark, sf):
    store = tag_store(spark, sf)
    return T.exclude_filtered(T.like_match_rows(store, PROBE), PROBE)


@query("like_minus_exact_tags", "WITH " + _BASE + ",\n" + _EXACT_ROWS + ",\n" + _LIKE_ROWS +
       "\nSELECT DISTINCT mood, tag FROM like_kept EXCEPT SELECT DISTINCT mood, tag FROM exact_rows")
def q_like_minus_exact(spark, sf):
    return T.like_minus_exact(tag_store(spark, sf), PROBE)


@query("match_coverage", "WITH " + _BASE + ",\n" + _EXACT_ROWS + ",\n" + _LIKE_ROWS + """,
moods AS (SELECT DISTINCT mood FROM lex_exact),
ex AS (SELECT mood, count(*) AS n FROM exact_rows GROUP BY mood),
lk AS (SELECT mood, count(*) AS n FROM like_rows GROUP BY mood),
lf AS (SELECT mood, count(*) AS n FROM like_kept GROUP BY mood)
SELECT m.mood, coalesce(ex.n, 0) AS exact_rows, coalesce(lk.n, 0) AS like_rows,
       coalesce(lf.n, 0) AS like_rows_filtered,
       coalesce(lf.n, 0) - coalesce(ex.n, 0) AS gain,
       CASE WHEN coalesce(ex.n, 0) > 0 THEN round(coalesce(lf.n, 0) / ex.n * 100, 5) ELSE -1.0 END AS pct
FROM moods m LEFT JOIN ex ON m.mood = ex.mood LEFT JOIN lk ON m.mood = lk.mood
LEFT JOIN lf ON m.mood = lf.mood""")
def q_match_coverage(spark, sf):
    return T.match_coverage(tag_store(spark, sf), PROBE)


@query("table_profile", """
SELECT 'tids' AS table_name, 'tid_id,tid' AS columns, count(*) AS n_rows FROM orders
UNION ALL SELECT 'tags', 'tag_id,tag', count(*) FROM part
UNION ALL SELECT 'tid_tag', 'tid_id,tag_id,val,tag_ord', count(*) FROM lineitem""")
def q_table_profile(spark, sf):
    """Column names and row count of each tag-store table."""
    store = tag_store(spark, sf)
    parts = [(n, df) for n, df in (("tids", store.tids), ("tags", store.tags),
                                   ("tid_tag", store.tid_tag))]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(",".join(df.columns)).alias("columns"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("peek", """
SELECT l_orderkey AS tid_id, l_partkey AS tag_id, l_quantity AS val
FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 5""")
def q_peek(spark, sf):
    """The first rows of a table, in an explicit order."""
    tt = tag_store(spark, sf).tid_tag
    return tt.orderBy("tid_id", "tag_ord").limit(5).select("tid_id", "tag_id", "val")


_HIST_SQL = """
WITH c AS (
  SELECT p.p_name AS tag, count(o.o_orderkey) AS n_songs
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey JOIN part p ON li.l_partkey = p.p_partkey
  GROUP BY p.p_name),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_songs DESC, tag) AS rk FROM c),
scoped AS (SELECT 'all' AS scope, n_songs FROM ranked
           UNION ALL SELECT 'top100', n_songs FROM ranked WHERE rk <= 100
           UNION ALL SELECT 'top50', n_songs FROM ranked WHERE rk <= 50),
s AS (SELECT scope, min(n_songs) AS mn, max(n_songs) AS mx FROM scoped GROUP BY scope),
b AS (SELECT sc.scope, CAST(CASE WHEN s.mx = s.mn THEN 0
             ELSE least(floor((sc.n_songs - s.mn) * 10 / (s.mx - s.mn)), 9) END AS INTEGER) AS bin
      FROM scoped sc JOIN s ON sc.scope = s.scope),
pb AS (SELECT scope, bin, count(*) AS n FROM b GROUP BY scope, bin),
grid AS (SELECT s.scope, CAST(g.bin AS INTEGER) AS bin, s.mn, s.mx FROM s, range(10) g(bin))
SELECT g.scope, g.bin, round(g.mn + g.bin * (g.mx - g.mn) / 10, 5) AS lo,
       round(g.mn + (g.bin + 1) * (g.mx - g.mn) / 10, 5) AS hi, CAST(coalesce(pb.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN pb ON g.scope = pb.scope AND g.bin = pb.bin"""


@query("tag_histogram", _HIST_SQL)
def q_tag_histogram(spark, sf):
    """A14 over all tags, the top 100 and the top 50 (by songs, tag as tie-break)."""
    counts = T.songs_per_tag(tag_store(spark, sf))
    out = T.tag_histogram(counts).select(F.lit("all").alias("scope"), "*")
    for n in (100, 50):
        top = counts.orderBy(F.desc("n_songs"), "tag").limit(n)
        out = out.unionByName(T.tag_histogram(top).select(F.lit(f"top{n}").alias("scope"), "*"))
    return out
