"""L2: label an indexed song table with one mood per song.

Only songs that are English and have lyrics are looked up; the others
keep ``mood=''``, ``found_tags=-1``, ``matched_mood=-1`` and NULL scores.
There is no split-and-re-merge: one left join from songs to the per-song
label table, and ``when(eligible, ...)`` decides per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import tags as T
from cadenza.operators.frames import add_col_if_absent
from cadenza.operators.lexicon import Lexicon
from cadenza.sources.tables import TagStore


def label_songs(songs: DataFrame, store: TagStore, lex: Lexicon, mode: str = "expanded",
                prefix: str | None = None) -> DataFrame:
    """Songs (with msd_id, msd_artist, is_english, lyrics_available) ->
    songs + mood, found_tags, matched_mood (+ one score column per mood).

    ``prefix`` keeps only artists starting with it (the label run drops the
    others, unlike the index run)."""
    df = songs
    for c, v in (("mood", ""), ("found_tags", -1), ("matched_mood", -1)):
        df = add_col_if_absent(df, c, v)
    if prefix:
        df = df.where(F.lower("msd_artist").startswith(prefix.lower()))
    moods = lex.moods_sorted
    if mode == "expanded":
        labels = T.label_expanded(store, lex)
        score_cols = moods
    elif mode == "exact":
        labels = T.label_exact(store, lex)
        for m in moods:
            labels = labels.withColumn(m, F.lit(0).cast("long"))
        score_cols = moods
    else:
        raise ValueError(f"mode must be 'expanded' or 'exact', not {mode!r}")
    labels = labels.select(F.col("tid").alias("_tid"),
                           F.col("found_tags").alias("_found"),
                           F.col("matched_mood").alias("_matched"),
                           F.col("mood").alias("_mood"),
                           *[F.col(m).alias(f"_s_{m}") for m in score_cols])
    eligible = (F.col("is_english") == 1) & (F.col("lyrics_available") == 1)
    j = df.join(labels, df["msd_id"] == labels["_tid"], "left")
    keep = [c for c in df.columns if c not in ("mood", "found_tags", "matched_mood")
            and c not in score_cols]
    # A song missing from the tag store is looked up and finds nothing.
    return j.select(
        *keep,
        F.when(eligible, F.coalesce("_mood", F.lit("unknown"))).otherwise(F.col("mood")).alias("mood"),
        F.when(eligible, F.coalesce("_found", F.lit(0))).otherwise(F.col("found_tags"))
         .cast("int").alias("found_tags"),
        F.when(eligible, F.coalesce("_matched", F.lit(0))).otherwise(F.col("matched_mood"))
         .cast("int").alias("matched_mood"),
        *[F.when(eligible, F.coalesce(F.col(f"_s_{m}"), F.lit(0))).cast("long").alias(m)
          for m in score_cols])


def label_counters(labelled: DataFrame) -> DataFrame:
    """A16 for a label run: looked up, with tags, no match, labelled."""
    return labelled.agg(
        F.count_if(F.col("found_tags") >= 0).alias("processed"),
        F.count_if(F.col("found_tags") > 0).alias("with_tags"),
        F.count_if((F.col("found_tags") > 0) & (F.col("matched_mood") == 0)).alias("no_match"),
        F.count_if(F.col("matched_mood") == 1).alias("labelled"),
    )
