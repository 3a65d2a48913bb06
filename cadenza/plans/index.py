"""L1: index a song table against a lyric corpus.

Per song: derive the lyric file name, look the text up in the corpus,
mark availability, language and word count. Rows already processed
(``lyrics_available >= 0``) keep their stored values, rows outside an
artist prefix are passed through untouched, and a language-detector
failure (NULL language) leaves the row unprocessed, so re-running the
plan over its own output changes nothing (idempotent resume).

Scale: the text never crosses the shuffle. Availability, word count and
language are computed next to the corpus scan; only those small columns
are joined (one equi-join on the file name, AQE re-plans it as a
broadcast if the corpus side turns out small).

A resumed run pays for its unprocessed rows only. Rows that are done or out of
scope bypass the join. The file names of the others set bits of a bitmap of
fixed size (``name_filter``), which every corpus scan probes before it looks at
a text: words are counted only in texts that some unprocessed row may want.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import prefix_match, safe_file_name, word_count
from cadenza.operators.frames import add_col_if_absent

INDEX_COLUMNS = {"is_english": -1, "lyrics_available": -1, "wordcount": -1,
                 "lyrics_filename": "-1"}


def corpus_stats(corpus: DataFrame, lang_col: str | None = "lang") -> DataFrame:
    """(lyrics_filename, has_text, n_words, lang) computed beside the scan.

    A file whose content is empty counts as "no lyrics"."""
    has_text = F.coalesce(F.length("lyrics") > 0, F.lit(False))
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    return corpus.select(
        "lyrics_filename",
        has_text.alias("has_text"),
        F.when(has_text, word_count(F.col("lyrics"))).otherwise(0).alias("n_words"),
        lang.alias("lang"))


#: Bits of the filter of file names. Its size is fixed; names beyond it let more texts through, never fewer.
FILTER_BITS = 1 << 25
_BUCKET_BITS = 32768  # of one row of Spark's bitmap aggregate


def name_filter(names: DataFrame, col: str, bits: int = FILTER_BITS) -> DataFrame:
    """(_bucket, _bits): one bit for every hash of a file name; at most ``bits`` / 32768 rows of 4 KB."""
    h = names.select(F.pmod(F.xxhash64(col), F.lit(bits)).alias("_h"))
    return h.groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))


def may_hold(rows: DataFrame, col: str, filter_rows: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` whose ``col`` has its bit in the filter: all that are wanted and a few more."""
    h = F.pmod(F.xxhash64(col), F.lit(bits))
    at = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(h)).join(F.broadcast(filter_rows), "_bucket")
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_bucket", "_bits"))


def index_songs(mapping: DataFrame, corpus: DataFrame | None = None, prefix: str | None = None,
                lang_col: str | None = "lang", stats: DataFrame | None = None) -> DataFrame:
    """Return ``mapping`` + (is_english, lyrics_available, wordcount, lyrics_filename).

    ``corpus`` has (lyrics_filename, lyrics[, lang]); ``lang`` stands for
    the detector's answer (NULL = detector error). ``stats`` is the result of
    ``corpus_stats`` if it is there already."""
    df = mapping
    for c, v in INDEX_COLUMNS.items():
        df = add_col_if_absent(df, c, v)
    df = df.withColumn("lyrics_filename", F.col("lyrics_filename").cast("string"))
    for c in ("is_english", "lyrics_available", "wordcount"):
        df = df.withColumn(c, F.col(c).cast("int"))
    rest = [c for c in df.columns if c not in INDEX_COLUMNS]
    in_scope = prefix_match(F.col("msd_artist"), prefix) if prefix else F.lit(True)
    wanted = F.coalesce(in_scope & (F.col("lyrics_available") < 0), F.lit(False))
    done = df.where(~wanted).select(*rest, *INDEX_COLUMNS)
    todo = df.where(wanted).withColumn("_fn", safe_file_name(F.col("msd_artist"), F.col("msd_title")))

    texts = may_hold((stats if stats is not None else corpus).withColumnRenamed("lyrics_filename", "_fn"), "_fn",
                     name_filter(todo, "_fn"))
    if stats is None:
        texts = corpus_stats(texts.withColumnRenamed("_fn", "lyrics_filename"), lang_col).withColumnRenamed("lyrics_filename", "_fn")
    j = todo.join(texts, "_fn", "left")
    found = F.coalesce(F.col("has_text"), F.lit(False))
    update = ~(found & F.col("lang").isNull())  # not where the detector failed

    def new(value, col: str):
        return F.when(update, value).otherwise(F.col(col)).cast("int").alias(col)

    indexed = j.select(
        *rest, new(F.when(found & (F.col("lang") == "en"), 1).otherwise(0), "is_english"),
        new(F.when(found, 1).otherwise(0), "lyrics_available"),
        new(F.when(found, F.col("n_words")).otherwise(0), "wordcount"),
        F.when(update, F.col("_fn")).otherwise(F.col("lyrics_filename")).alias("lyrics_filename"))
    return indexed.unionByName(done)


def index_counters(indexed: DataFrame) -> DataFrame:
    """A16 for an index run: processed, not English, lacking lyrics, ready."""
    return indexed.agg(
        F.count_if(F.col("lyrics_available") >= 0).alias("processed"),
        F.count_if((F.col("lyrics_available") == 1) & (F.col("is_english") == 0)).alias("not_english"),
        F.count_if(F.col("lyrics_available") == 0).alias("no_lyrics"),
        F.count_if((F.col("lyrics_available") == 1) & (F.col("is_english") == 1)).alias("ready"),
        F.count_if(F.col("lyrics_available") < 0).alias("unprocessed"),
    )
