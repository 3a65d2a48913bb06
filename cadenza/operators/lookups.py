"""Work-list joins of the scraping stage (J11-J13), as set operations.

* J11 skip rows equal in all six mapping columns to a known-bad row
  (null-safe left-anti join);
* J12 skip rows whose lyric file already exists (left-anti against the
  corpus listing) / keep only rows with a file (left-semi);
* J13 look a song up in a catalogue under up to four spellings of
  (title, artist), in priority order; the first spelling that hits wins.
  The candidates are generated per row (at most four), joined with one
  equi-join to the smallest catalogue id of each (title, artist) - a song can
  win no other - and the winner is a ``min`` per song, so a title and artist
  that many songs and entries share don't meet as pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.files import MAPPING_COLUMNS


def drop_known_bad(mapping: DataFrame, known_bad: DataFrame,
                   cols: list[str] = MAPPING_COLUMNS) -> DataFrame:
    """Left-anti on all columns with NULL-safe equality."""
    kb = known_bad.select(*[F.col(c).alias(f"_kb_{c}") for c in cols]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_kb_{c}")) for c in cols])
    return mapping.join(kb, cond, "left_anti")


def missing_files(songs: DataFrame, listing: DataFrame, col: str = "lyrics_filename") -> DataFrame:
    """Rows whose file is not in the listing yet (the to-do list)."""
    return songs.join(listing.select(col).distinct(), col, "left_anti")


def present_files(songs: DataFrame, listing: DataFrame, col: str = "lyrics_filename") -> DataFrame:
    """Rows whose file exists."""
    return songs.join(listing.select(col).distinct(), col, "left_semi")


def candidate_keys(mapping: DataFrame) -> DataFrame:
    """The (title, artist) spellings to try, with priority:
    1 (msd_title, msd_artist); 2 (msd_title, mxm_artist) if the artists
    differ; 3 (mxm_title, msd_artist) if the titles differ; 4 (mxm_title,
    mxm_artist) if both differ."""
    t_diff = F.col("msd_title") != F.col("mxm_title")
    a_diff = F.col("msd_artist") != F.col("mxm_artist")

    def cand(prio, title, artist, use):
        return F.struct(F.lit(prio).alias("prio"), F.col(title).alias("title"),
                        F.col(artist).alias("artist"), use.alias("use"))

    c = F.array(
        cand(1, "msd_title", "msd_artist", F.lit(True)),
        cand(2, "msd_title", "mxm_artist", F.coalesce(a_diff, F.lit(False))),
        cand(3, "mxm_title", "msd_artist", F.coalesce(t_diff, F.lit(False))),
        cand(4, "mxm_title", "mxm_artist", F.coalesce(t_diff & a_diff, F.lit(False))),
    )
    e = mapping.select("msd_id", F.explode(c).alias("k"))
    return e.where("k.use").select("msd_id", F.col("k.prio").alias("prio"),
                                   F.col("k.title").alias("title"), F.col("k.artist").alias("artist"))


def fallback_lookup(mapping: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns (found = (msd_id, prio, catalogue_id), misses = mapping rows
    without any hit, for the append-only reject log)."""
    cand = candidate_keys(mapping)
    first = catalogue.groupBy("title", "artist").agg(F.min(F.struct("catalogue_id")).alias("c"))
    hits = cand.join(first, ["title", "artist"])
    best = hits.groupBy("msd_id").agg(F.min(F.struct("prio", "c.catalogue_id")).alias("b"))
    found = best.select("msd_id", F.col("b.prio").alias("prio"), F.col("b.catalogue_id").alias("catalogue_id"))
    misses = mapping.join(found.select("msd_id"), "msd_id", "left_anti")
    return found, misses
