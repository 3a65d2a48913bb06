"""Tag algebra: songs x crowd tags x mood lexicon.

Plan shape used throughout (the reference loops songs and sends one SQL
query per song; here everything is set-based):

1. Score every *distinct tag text* once against the lexicon. Terms are found
   through an inverted index of their first characters: a text's short
   substrings meet the terms that begin with them in an equi-join, and the few
   candidates are compared. The work follows the texts' length and the hits,
   not the number of terms; no pair of text and term is formed otherwise.
2. Carry the per-tag result to ``tag_id`` with an equi-join, pivot it to
   one row per tag so the big join below never multiplies rows.
3. One left join ``tid_tag -> per-tag deltas`` (AQE broadcasts the per-tag
   side when its measured size is small, otherwise sort-merge with skew
   splitting), then ONE aggregation keyed by song, partially aggregated
   map-side, so a hot song or tag does not pile up in one task.
4. Winners, pivots and flags are column expressions on that row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.lexicon import (
    UNKNOWN_MOOD,
    Lexicon,
    exact_terms_df,
    filter_terms_df,
    like_terms_df,
)
from cadenza.sources.sinks import materialise
from cadenza.sources.tables import TagStore


def _occurrences(text: Column, term: Column, literal: bool) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text``."""
    if literal:
        return F.floor((F.length(text) - F.length(F.replace(text, term, F.lit(""))))
                       / F.length(term)).cast("long")
    return F.regexp_count(text, term).cast("long")


#: Characters of a term's beginning by which it is indexed.
ANCHOR = 3


def term_hits(texts: DataFrame, col: str, terms: DataFrame, listed: dict[str, list[str]]) -> DataFrame:
    """Rows of ``texts`` joined with every row of ``terms`` whose ``term`` stands in ``col``, overlapping or not.

    ``terms`` is the table of a lexicon's ``listed`` terms, so it is broadcast. Their beginnings of up to ``ANCHOR``
    characters decide which substring lengths of a text are looked up; the empty term stands in every text.
    """
    starts = terms.where("term IS NOT NULL").withColumn("_gram", F.substring("term", 1, ANCHOR))
    sizes = sorted({min(len(t), ANCHOR) for ts in listed.values() for t in ts})
    c = F.col(col)

    def grams(n: int):
        if not n:
            return F.array(F.lit(""))
        every = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: c.substr(i, F.lit(n)))
        return F.when(F.length(c) >= n, every).otherwise(F.array().cast("array<string>"))

    parts = [grams(n) for n in sizes] or [F.array().cast("array<string>")]
    cut = texts.select("*", F.explode(F.array_distinct(F.concat(*parts))).alias("_gram"))
    return cut.join(F.broadcast(starts), "_gram").where(c.contains(F.col("term"))).drop("_gram")


def _found(texts: DataFrame, col: str, terms: DataFrame, listed: dict[str, list[str]], literal: bool) -> DataFrame:
    """``term_hits``; a lexicon with patterns among its terms is matched as patterns, each text with each."""
    return term_hits(texts, col, terms, listed) if literal else texts.join(F.broadcast(terms), F.rlike(F.col(col), F.col("term")))


def tag_text_deltas(tag_texts: DataFrame, lex: Lexicon) -> DataFrame:
    """Per distinct tag text and mood: ``delta = likes_hit * (1 - filter_hits)``.

    A tag hit by two like terms of one mood counts twice, and every filter
    occurrence inside a liked tag subtracts once per like hit, so deltas can
    be zero or negative (the published scoreboard behaves the same way).
    Input: ``(tag)`` distinct. Output: ``(tag, mood, mood_ord, n_like, delta)``.
    """
    spark = tag_texts.sparkSession
    literal = lex.is_literal()
    hits = (_found(tag_texts.select("tag"), "tag", like_terms_df(spark, lex), lex.like, literal)
            .groupBy("tag", "mood", "mood_ord").agg(F.count(F.lit(1)).alias("n_like")))
    liked = hits.select("tag", F.col("mood").alias("_mood"))
    fhits = (_found(liked.select("tag").distinct(), "tag", filter_terms_df(spark, lex), lex.filters, literal)
             .join(liked, "tag").where("mood = _mood").groupBy("tag", "mood")
             .agg(F.sum(_occurrences(F.col("tag"), F.col("term"), literal)).alias("n_filter")))
    return (hits.join(fhits, ["tag", "mood"], "left")
            .select("tag", "mood", "mood_ord", "n_like",
                    (F.col("n_like") * (F.lit(1) - F.coalesce("n_filter", F.lit(0))))
                    .cast("long").alias("delta")))


def tag_deltas(tags: DataFrame, lex: Lexicon) -> DataFrame:
    """``(tag_id, mood, mood_ord, delta)`` for tags hit by a like term."""
    texts = tags.select("tag").distinct()
    return tags.join(tag_text_deltas(texts, lex), "tag").select(
        "tag_id", "mood", "mood_ord", "delta")


def _tag_delta_wide(tags: DataFrame, lex: Lexicon) -> DataFrame:
    """One row per tag id of the tag table, one delta column per mood
    (NULL = no like hit). Covering every tag lets the big join below be an
    inner join that drops tag rows whose tag does not exist (as the
    three-way join of the tag store does)."""
    moods = lex.moods_sorted
    d = tag_deltas(tags, lex)
    wide = d.groupBy("tag_id").agg(
        *[F.sum(F.when(F.col("mood") == m, F.col("delta"))).alias(f"d_{i}")
          for i, m in enumerate(moods)])
    return tags.select("tag_id").join(wide, "tag_id", "left")


def tag_rows(store: TagStore) -> DataFrame:
    """Tids |><| tid_tag |><| tags as one set-based join.

    Output ``(tid_id, tid, tag_id, tag, val, tag_ord)``. The tag table joins
    first: tag predicates (lookups, lexicon matches) are pushed into its scan
    and shrink the tag rows before they meet the song table."""
    return (store.tid_tag.join(store.tags, "tag_id").join(store.tids, "tid_id")
            .select("tid_id", "tid", "tag_id", "tag", "val", "tag_ord"))


def scoreboard_long(store: TagStore, lex: Lexicon) -> DataFrame:
    """A7 in long form: ``(tid_id, mood, score)`` for every (song, mood) with at
    least one like hit among the song's tags. Scores may be <= 0.

    Tag rows meet the per-tag deltas first and are summed per (song, mood)
    with a map-side partial aggregate; only the aggregated board is then
    restricted to known songs (a semi join on far fewer rows)."""
    d = tag_deltas(store.tags, lex)
    board = (store.tid_tag.join(d, "tag_id")
             .groupBy("tid_id", "mood").agg(F.sum("delta").cast("long").alias("score")))
    return board.join(store.tids.select("tid_id"), "tid_id", "left_semi")


def _holding(listed: dict[str, list[str]], literal: bool) -> Callable[[Column], Column]:
    """Condition on a text: it holds one of the listed terms."""
    terms = sorted({t for ts in listed.values() for t in ts if t is not None})

    def holds(text: Column) -> Column:
        found = [text.contains(t) if literal else F.rlike(text, F.lit(t)) for t in terms]
        return reduce(lambda a, b: a | b, found, F.lit(False))

    return holds


def _mentioning(listed: dict[str, list[str]]) -> Callable[[Column], Column]:
    """``_holding`` for literal terms as one pattern: the text, however it is derived, stands in the condition once."""
    terms = sorted({t for ts in listed.values() for t in ts if t is not None})
    return lambda text: F.rlike(text, F.lit("|".join(f"\\Q{t}\\E" for t in terms))) if terms else F.lit(False)


def _equal(lex: Lexicon) -> Callable[[Column], Column]:
    """Condition on a text: it equals an exact term."""
    terms = sorted({t for ts in lex.exact.values() for t in ts if t is not None})
    return lambda text: text.isin(terms)


def _matching(store: TagStore, keep: Callable[[Column], Column], listed: dict[str, list[str]], literal: bool = True) -> TagStore:
    """A store derived from texts with only those tags that meet ``keep``, stored; others as they are.

    A tag that meets it holds one of the ``listed`` terms, so (unless they are patterns) its text does too."""
    if store.rows is None:
        return store
    rows = materialise(store.rows(keep, _mentioning(listed) if literal else None), "tag-hits")
    return replace(store, tags=rows.select("tag_id", F.col("tag_id").alias("tag")).distinct(), tid_tag=rows, rows=None)


def _found_tags(store: TagStore, per_song: DataFrame) -> DataFrame:
    """``per_song`` with a store's own counts of all tags, songs without a matching one included."""
    if store.found is None:
        return per_song
    return store.found.join(per_song.drop("found_tags"), "tid_id", "left")


def scoreboard_wide(store: TagStore, lex: Lexicon) -> DataFrame:
    """One row per song id that has tags: ``found_tags`` and one score per mood.

    One join to the per-tag table and exactly one aggregation keyed by song
    (partial aggregation map-side, so a hot song is pre-summed in every
    task). Callers restrict the result to the song table."""
    moods = lex.moods_sorted
    store = _matching(store, _holding(lex.like, lex.is_literal()), lex.like, lex.is_literal())
    rows = store.tid_tag.join(_tag_delta_wide(store.tags, lex), "tag_id")
    per_song = rows.groupBy("tid_id").agg(
        F.count(F.lit(1)).alias("found_tags"),
        *[F.coalesce(F.sum(f"d_{i}"), F.lit(0)).cast("long").alias(m)
          for i, m in enumerate(moods)])
    if store.found is None:
        return per_song
    return materialise(_found_tags(store, per_song).na.fill(0, moods), "board")  # a row a song: later filters end here


def winner_expr(moods: list[str]) -> Column:
    """Highest score wins if > 0; ties go to the earlier (alphabetical)
    mood; otherwise 'unknown'. Pure expression over the score columns."""
    cands = F.array(*[F.struct(F.col(m).alias("s"), F.lit(-i).alias("o"), F.lit(m).alias("m"))
                      for i, m in enumerate(moods)])
    best = F.array_max(cands)
    return F.when(best["s"] > 0, best["m"]).otherwise(F.lit(UNKNOWN_MOOD))


def label_expanded(store: TagStore, lex: Lexicon) -> DataFrame:
    """Expanded-mode labels for every song in ``tids``.

    ``(tid_id, tid, found_tags, matched_mood, mood, <one column per mood>)``;
    songs without tags get found_tags 0, mood 'unknown', scores 0."""
    moods = lex.moods_sorted
    board = scoreboard_wide(store, lex)
    out = store.tids.join(board, "tid_id", "left")
    out = out.select(
        "tid_id", "tid",
        F.coalesce("found_tags", F.lit(0)).cast("int").alias("found_tags"),
        *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in moods])
    mood = winner_expr(moods)
    return out.select(
        "tid_id", "tid", "found_tags",
        F.when(mood != UNKNOWN_MOOD, 1).otherwise(0).alias("matched_mood"),
        mood.alias("mood"), *moods)


def label_exact(store: TagStore, lex: Lexicon) -> DataFrame:
    """The first tag (in tag order) that equals an exact term decides;
    the mood is the first mood (lexicon order) holding that term.

    One join to a per-tag table (one row per tag) and one aggregation keyed
    by song give both ``found_tags`` and the first hit, the smallest
    ``(tag_ord, mood_ord)`` of any range.
    ``(tid_id, tid, found_tags, matched_mood, mood)``."""
    spark = store.tags.sparkSession
    moods = lex.moods_exact_order
    exact = F.broadcast(exact_terms_df(spark, lex))
    store = _matching(store, _equal(lex), lex.exact)
    tag_moods = (store.tags.join(exact, F.col("tag") == F.col("term"))
                 .groupBy("tag_id").agg(F.min("mood_ord").alias("mood_ord")))
    per_tag = store.tags.select("tag_id").join(tag_moods, "tag_id", "left")
    rows = store.tid_tag.join(per_tag, "tag_id")
    key = F.when(F.col("mood_ord").isNotNull(), F.struct("tag_ord", "mood_ord"))
    per_song = rows.groupBy("tid_id").agg(F.count(F.lit(1)).alias("found_tags"),
                                          F.min(key).alias("first"))
    names = F.array(*[F.lit(m) for m in moods])
    out = store.tids.join(_found_tags(store, per_song), "tid_id", "left")
    # guard the lookup: element_at over a literal array with a NULL index is
    # not reliably NULL in generated code
    mood = F.when(F.col("first").isNotNull(),
                  F.element_at(names, F.col("first.mood_ord").cast("int")))
    return out.select(
        "tid_id", "tid",
        F.coalesce("found_tags", F.lit(0)).cast("int").alias("found_tags"),
        F.when(F.col("first").isNotNull(), 1).otherwise(0).alias("matched_mood"),
        F.coalesce(mood, F.lit(UNKNOWN_MOOD)).alias("mood"))


# --------------------------------------------------------------------------
# Lookups and counts over the tag store
# --------------------------------------------------------------------------

def songs_for_tag(store: TagStore, tag: str) -> DataFrame:
    """All songs carrying one tag, as a parameterised statement (the
    value is bound, never spliced into SQL text)."""
    spark = store.tags.sparkSession
    return spark.sql("SELECT tid_id, tid, tag, val FROM {rows} WHERE tag = :tag",
                     args={"tag": tag}, rows=tag_rows(store))


def tags_for_song(store: TagStore, tid: str) -> DataFrame:
    """``(tid, tag, val)`` of one song, parameterised."""
    spark = store.tags.sparkSession
    return spark.sql("SELECT tid_id, tid, tag, val FROM {rows} WHERE tid = :tid",
                     args={"tid": tid}, rows=tag_rows(store))


def tags_per_song(store: TagStore) -> DataFrame:
    """``(tid_id, found_tags)`` with 0 for songs without tags."""
    n = (store.tid_tag.join(store.tags.select("tag_id"), "tag_id", "left_semi")
         .groupBy("tid_id").agg(F.count(F.lit(1)).alias("n")))
    return store.tids.join(n, "tid_id", "left").select(
        "tid_id", F.coalesce("n", F.lit(0)).cast("long").alias("found_tags"))


def songs_per_tag(store: TagStore) -> DataFrame:
    """A1: ``(tag, n_songs)`` = COUNT(tid) per tag text.

    Rows of known songs are counted per tag id first, so a popular tag is one
    row per task before it meets the tag texts."""
    known = store.tid_tag.select("tid_id", "tag_id").join(store.tids.select("tid_id"), "tid_id")
    per_id = known.groupBy("tag_id").agg(F.count(F.lit(1)).alias("_n"))
    return (per_id.join(store.tags.select("tag_id", "tag"), "tag_id").groupBy("tag")
            .agg(F.sum("_n").alias("n_songs")))


def exact_match_rows(store: TagStore, lex: Lexicon) -> DataFrame:
    """(song, tag) rows whose tag equals an exact term, all moods in one
    pass: ``(mood, tid_id, tag_id, tag)``."""
    spark = store.tags.sparkSession
    exact = F.broadcast(exact_terms_df(spark, lex))
    store = _matching(store, _equal(lex), lex.exact)
    tag_moods = store.tags.join(exact, F.col("tag") == F.col("term")).select(
        "tag_id", "mood").distinct()
    return tag_rows(store).join(tag_moods, "tag_id").select("mood", "tid_id", "tag_id", "tag")


def like_tag_moods(tags: DataFrame, lex: Lexicon) -> DataFrame:
    """Distinct (tag_id, tag, mood) where the tag LIKE-matches a like term of
    the mood (case-insensitive, each tag once per mood however many terms
    hit). Scored on distinct tag texts."""
    spark = tags.sparkSession
    likes = like_terms_df(spark, lex).select("mood", F.lower("term").alias("term"))
    texts = tags.select("tag").distinct().withColumn("_low", F.lower("tag"))
    hit = term_hits(texts, "_low", likes, {m: [t.lower() for t in ts] for m, ts in lex.like.items()}).select("tag", "mood").distinct()
    return tags.join(hit, "tag").select("tag_id", "tag", "mood")


def like_match_rows(store: TagStore, lex: Lexicon) -> DataFrame:
    """``(mood, tid_id, tag_id, tag)`` rows matched by LIKE."""
    m = like_tag_moods(store.tags, lex)
    return tag_rows(store).join(m.select("tag_id", "mood"), "tag_id").select(
        "mood", "tid_id", "tag_id", "tag")


def exclude_filtered(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """Drop rows whose lower-case tag contains any filter term of the row's
    mood (terms used as given, so capitalised terms never hit). Evaluated on
    distinct (mood, tag) pairs, then a left-anti equi-join."""
    bad = _filtered(rows.select("mood", "tag").distinct(), lex)
    return rows.join(bad, ["mood", "tag"], "left_anti")


def _filtered(pairs: DataFrame, lex: Lexicon) -> DataFrame:
    """Those of the distinct (mood, tag) ``pairs`` whose lower-case tag holds a filter term of the mood."""
    filters = filter_terms_df(pairs.sparkSession, lex).select("mood", "term").distinct()
    texts = pairs.select("tag").distinct().withColumn("_low", F.lower("tag"))
    found = _found(texts, "_low", filters, lex.filters, lex.is_literal()).select("mood", "tag").distinct()
    return pairs.join(found, ["mood", "tag"], "left_semi")


def like_minus_exact(store: TagStore, lex: Lexicon) -> DataFrame:
    """Distinct (mood, tag) found by LIKE (after filters) but not by equality."""
    like = exclude_filtered(like_match_rows(store, lex), lex).select("mood", "tag").distinct()
    exact = exact_match_rows(store, lex).select("mood", "tag").distinct()
    return like.subtract(exact)


def _tag_mood_flags(tags: DataFrame, lex: Lexicon) -> DataFrame:
    """Per (tag_id, mood): is the tag an exact term, a LIKE hit, and is the
    LIKE hit removed by a filter term. Built on the tag table only (small);
    the big tag-row table is then read once for all three counts."""
    spark = tags.sparkSession
    exact = F.broadcast(exact_terms_df(spark, lex))
    ex = (tags.join(exact, F.col("tag") == F.col("term")).select("tag_id", "mood").distinct()
          .withColumn("is_exact", F.lit(True)))
    like = like_tag_moods(tags, lex)
    bad = _filtered(like.select("mood", "tag").distinct(), lex).withColumn("filtered", F.lit(True))
    lk = (like.join(bad, ["mood", "tag"], "left")
          .select("tag_id", "mood", F.lit(True).alias("is_like"),
                  F.coalesce("filtered", F.lit(False)).alias("filtered")))
    return (ex.join(lk, ["tag_id", "mood"], "full")
            .select("tag_id", "mood", F.coalesce("is_exact", F.lit(False)).alias("is_exact"),
                    F.coalesce("is_like", F.lit(False)).alias("is_like"),
                    F.coalesce("filtered", F.lit(False)).alias("filtered")))


def match_coverage(store: TagStore, lex: Lexicon) -> DataFrame:
    """A17 per mood: exact rows, like rows, like rows after filters, gain and
    like/exact percentage (-1 when there is no exact row). One pass over
    the tag rows joined to small per-tag flags."""
    spark = store.tags.sparkSession
    moods = spark.createDataFrame([(m,) for m in lex.moods_sorted], "mood string")
    flags = _tag_mood_flags(store.tags, lex)
    rows = store.tid_tag.join(store.tags.select("tag_id"), "tag_id").join(
        store.tids.select("tid_id"), "tid_id").join(flags, "tag_id")
    per = rows.groupBy("mood").agg(
        F.count_if("is_exact").alias("exact_rows"),
        F.count_if("is_like").alias("like_rows"),
        F.count_if(F.col("is_like") & ~F.col("filtered")).alias("like_rows_filtered"))
    out = (F.broadcast(moods).join(per, "mood", "left")
           .na.fill(0, ["exact_rows", "like_rows", "like_rows_filtered"]))
    return out.select(
        "mood", "exact_rows", "like_rows", "like_rows_filtered",
        (F.col("like_rows_filtered") - F.col("exact_rows")).alias("gain"),
        F.when(F.col("exact_rows") > 0,
               F.round(F.col("like_rows_filtered") / F.col("exact_rows") * 100, 5))
        .otherwise(F.lit(-1.0)).alias("pct"))


def tag_histogram(counts: DataFrame, value: str = "n_songs", bins: int = 10) -> DataFrame:
    """Equal-width histogram of ``value`` between its min and max, the
    last bin closed. Integer arithmetic, so bin edges never wobble. min and
    max are scalar subqueries (one small aggregate each, no join).
    Output ``(bin, lo, hi, n)`` with empty bins present."""
    spark = counts.sparkSession
    v = value
    return spark.sql(f"""
        WITH s AS (SELECT (SELECT min({v}) FROM {{c}}) AS mn, (SELECT max({v}) FROM {{c}}) AS mx),
        b AS (
          SELECT CAST(CASE WHEN (SELECT mx FROM s) = (SELECT mn FROM s) THEN 0
                      ELSE least(floor(({v} - (SELECT mn FROM s)) * {bins}
                                 / ((SELECT mx FROM s) - (SELECT mn FROM s))), {bins - 1}) END AS INT) AS bin
          FROM {{c}}),
        per_bin AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
        grid AS (SELECT CAST(id AS INT) AS bin FROM range({bins}))
        SELECT g.bin,
               round((SELECT mn FROM s) + g.bin * ((SELECT mx FROM s) - (SELECT mn FROM s)) / {bins}, 5) AS lo,
               round((SELECT mn FROM s) + (g.bin + 1) * ((SELECT mx FROM s) - (SELECT mn FROM s)) / {bins}, 5) AS hi,
               CAST(coalesce(p.n, 0) AS BIGINT) AS n
        FROM grid g LEFT JOIN per_bin p ON g.bin = p.bin""", c=counts)
