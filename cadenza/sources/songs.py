"""Song-table and lyric-corpus views over the driver tables.

* ``documents`` stands in for songs with lyrics: msd_id = doc_id,
  artist = source, title = 'doc <id>', lyrics = text, the detector's
  language = lang.
* ``orders`` stands in for the indexed songs that the tag store labels
  (msd_id = order key, the same key the tag store uses).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.text import safe_file_name, word_count
from cadenza.sources.tables import read_table


def song_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msd_id, msd_artist, msd_title) - the raw mapping, no index columns."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("msd_id"),
                    F.col("source").alias("msd_artist"),
                    F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("msd_title"))


def lyric_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lyrics_filename, lyrics, lang): one text per file name."""
    d = read_table(spark, sf_dir, "documents")
    fn = safe_file_name(F.col("source"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return d.select(fn.alias("lyrics_filename"), F.col("text").alias("lyrics"), "lang")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-ready song rows: the nine training columns + lyrics, with the
    document language as the class (four classes, imbalanced)."""
    d = read_table(spark, sf_dir, "documents")
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id"),
        F.col("doc_id").cast("string").alias("msd_id"),
        F.col("source").alias("msd_artist"),
        title.alias("msd_title"),
        F.lit(1).alias("is_english"),
        F.when(F.length("text") > 0, 1).otherwise(0).alias("lyrics_available"),
        word_count(F.col("text")).alias("wordcount"),
        safe_file_name(F.col("source"), title).alias("lyrics_filename"),
        F.col("lang").alias("mood"),
        F.lit(1).alias("matched_mood"),
        F.col("text").alias("lyrics"),
    )


def indexed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed song rows keyed like the tag store: English unless the order
    status is 'P', lyrics unless the priority is '5-LOW'."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("msd_id"),
        F.concat(F.lit("artist "), F.col("o_custkey").cast("string")).alias("msd_artist"),
        F.concat(F.lit("title "), F.col("o_orderkey").cast("string")).alias("msd_title"),
        F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("is_english"),
        F.when(F.col("o_orderpriority") != "5-LOW", 1).otherwise(0).alias("lyrics_available"),
    )
