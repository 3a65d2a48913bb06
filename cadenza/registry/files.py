"""Source / sink queries: each writes data derived from the driver tables to
the shared scratch folder in a reference file format, reads it back with
the matching source, and returns what was read (S1-S7, S12-S18, F2) -
plus the work-list joins J11-J13."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import text as TX
from cadenza.operators import lookups as LK
from cadenza.operators import metrics as ME
from cadenza.operators import vocab as V
from cadenza.plans.dataset import attach_lyrics
from cadenza.plans.index import index_songs
from cadenza.registry.base import query
from cadenza.registry.learning import _CM_SQL, _pairs
from cadenza.registry.songs import _index_sql
from cadenza.registry.sqlparts import doc_title_sql, file_name_sql
from cadenza.registry.text import _VOCAB_SQL, VOCAB_SIZE
from cadenza.session import scratch_path
from cadenza.sources import files as FS
from cadenza.sources import sinks as SK
from cadenza.sources.songs import labelled_documents, lyric_corpus, song_mapping
from cadenza.sources.tables import read_table


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, "queries", name, uuid.uuid4().hex)


_INDEXED_READ = T.StructType([
    T.StructField("msd_id", T.StringType()), T.StructField("msd_artist", T.StringType()),
    T.StructField("msd_title", T.StringType()), T.StructField("is_english", T.IntegerType()),
    T.StructField("lyrics_available", T.IntegerType()), T.StructField("wordcount", T.IntegerType()),
    T.StructField("lyrics_filename", T.StringType()),
])


@query("csv_roundtrip", _index_sql(None))
def q_csv_roundtrip(spark, sf):
    """S2 + S12: the index written as artist-ordered CSV and read back with a
    fixed schema."""
    path = _scratch(spark, "csv_roundtrip")
    idx = index_songs(song_mapping(spark, sf), lyric_corpus(spark, sf))
    SK.write_table(idx, path, fmt="csv", overwrite=True, sort_by=["msd_artist", "msd_id"], header=True)
    return FS.read_csv_table(spark, path, _INDEXED_READ)


@query("training_csv_import", f"""
SELECT CAST(doc_id AS VARCHAR) AS msd_id, lang AS mood,
       CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS wordcount
FROM documents""")
def q_training_csv_import(spark, sf):
    """Training CSV read with fixed dtypes and a column subset."""
    path = _scratch(spark, "training_csv")
    lab = labelled_documents(spark, sf).select(*[f.name for f in FS.TRAINING_SCHEMA.fields])
    SK.write_table(lab, path, fmt="csv", overwrite=True, header=True)
    return FS.read_csv_table(spark, path, FS.TRAINING_SCHEMA, usecols=["msd_id", "mood", "wordcount"])


@query("genre_tsv_join", """
WITH g AS (SELECT CAST(doc_id AS VARCHAR) AS msd_id,
                  'genre_' || CAST(quality AS VARCHAR) || '_' || CAST(toxic AS VARCHAR) AS magd_genre FROM labels)
SELECT CAST(d.doc_id AS VARCHAR) AS msd_id, d.lang AS mood, g.magd_genre
FROM documents d LEFT JOIN g ON CAST(d.doc_id AS VARCHAR) = g.msd_id""")
def q_genre_tsv_join(spark, sf):
    """S3 + J8 + L3: genre TSV (no header) written, read back, left-joined."""
    path = _scratch(spark, "genre_tsv")
    genre = read_table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("msd_id"),
        F.concat(F.lit("genre_"), F.col("quality").cast("string"), F.lit("_"),
                 F.col("toxic").cast("string")).alias("magd_genre"))
    SK.write_table(genre, path, fmt="csv", overwrite=True, sep="\t", header=False)
    songs = labelled_documents(spark, sf).select("msd_id", "mood")
    return songs.join(FS.read_genre_tsv(spark, path), "msd_id", "left")


def _mapping_from_part(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("msd_id"),
        F.col("p_brand").alias("msd_artist"),
        F.col("p_name").alias("msd_title"),
        F.col("p_partkey").cast("string").alias("mxm_id"),
        F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("mxm_artist"),
        F.when(F.col("p_size") % 3 == 0, F.regexp_replace("p_name", " ", "-"))
         .otherwise(F.col("p_name")).alias("mxm_title"),
        F.col("p_type"), F.col("p_size"))


_MAPPING_SQL = """mapping AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS msd_id, p_brand AS msd_artist, p_name AS msd_title,
         CAST(p_partkey AS VARCHAR) AS mxm_id,
         CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS mxm_artist,
         CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS mxm_title,
         p_type, p_size
  FROM part)"""


def _sep_lines(spark, sf):
    m = _mapping_from_part(spark, sf)
    six = F.concat_ws(FS.SEP, *[F.col(c) for c in FS.MAPPING_COLUMNS])
    five = F.concat_ws(FS.SEP, *[F.col(c) for c in FS.MAPPING_COLUMNS[:5]])
    # SMALL parts lose their last field: those lines must land in the rejects
    body = m.select(F.concat(F.when(F.col("p_type") == "SMALL", five).otherwise(six),
                             F.lit("  ")).alias("value"))
    header = spark.range(1).select(F.lit("# " + FS.SEP.join(FS.MAPPING_COLUMNS)).alias("value"))
    path = _scratch(spark, "sep_mapping")
    header.unionByName(body).write.mode("overwrite").text(path)
    return FS.read_sep_mapping(spark, path)


@query("sep_mapping_parse", "WITH " + _MAPPING_SQL + """
SELECT msd_id, msd_artist, msd_title, mxm_id, mxm_artist, mxm_title FROM mapping WHERE p_type <> 'SMALL'""")
def q_sep_mapping_parse(spark, sf):
    """S4: '<SEP>' text with a comment line parsed into six columns."""
    ok, _ = _sep_lines(spark, sf)
    return ok


@query("sep_mapping_rejects", "WITH " + _MAPPING_SQL + """
SELECT msd_id || '<SEP>' || msd_artist || '<SEP>' || msd_title || '<SEP>' || mxm_id || '<SEP>' || mxm_artist AS line,
       5 AS n_fields FROM mapping WHERE p_type = 'SMALL'""")
def q_sep_mapping_rejects(spark, sf):
    """Lines without six fields are set aside with their field count."""
    _, rejects = _sep_lines(spark, sf)
    return rejects


_FN = file_name_sql("source", doc_title_sql())


def _write_corpus(spark, sf, where=None):
    d = lyric_corpus(spark, sf)
    if where is not None:
        d = d.where(where)
    path = _scratch(spark, "corpus")
    # one directory per lyric file name, one text file inside it
    SK.write_text_corpus(d, path)
    return path


def _read_corpus(spark, path):
    return FS.read_text_corpus(spark, path, glob="*.txt", name_pattern=r"lyrics_filename=([^/]+)/[^/]+$")


@query("corpus_text_scan", f"""
SELECT {_FN} AS lyrics_filename, 'utf-8' AS encoding, CAST(length(text || chr(10)) AS INTEGER) AS n_chars,
       md5(text || chr(10)) AS lyrics_md5 FROM documents""")
def q_corpus_text_scan(spark, sf):
    """One text file per song written, then scanned as binary files with
    encoding detection."""
    c = _read_corpus(spark, _write_corpus(spark, sf))
    return c.select("lyrics_filename", "encoding", F.length("lyrics").alias("n_chars"),
                    F.md5("lyrics").alias("lyrics_md5"))


@query("corpus_lookup", f"""
SELECT CAST(d.doc_id AS VARCHAR) AS msd_id, md5(CASE WHEN d.lang = 'en' THEN d.text || chr(10) ELSE '' END) AS lyrics_md5
FROM documents d""")
def q_corpus_lookup(spark, sf):
    """Every song looks its file up by name; songs without a file get ''."""
    path = _write_corpus(spark, sf, F.col("lang") == "en")
    corpus = _read_corpus(spark, path)
    songs = song_mapping(spark, sf).withColumn(
        "lyrics_filename", TX.safe_file_name(F.col("msd_artist"), F.col("msd_title")))
    return attach_lyrics(songs, corpus).select("msd_id", F.md5("lyrics").alias("lyrics_md5"))


@query("json_song_scan", """
SELECT source AS doc_artist, 'doc ' || CAST(doc_id AS VARCHAR) AS title, 'album ' || lang AS album,
       source AS artist, md5(text) AS lyrics_md5 FROM documents""")
def q_json_song_scan(spark, sf):
    """Nested song JSON (artist + songs[]) written and read back with a
    fixed schema; one song per record keeps every record bounded."""
    d = read_table(spark, sf, "documents")
    song = F.struct(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("album "), F.col("lang")).alias("album"),
        F.lit("2000").alias("year"), F.col("text").alias("lyrics"), F.lit("").alias("image"),
        F.col("source").alias("artist"), F.lit("").alias("json"))
    path = _scratch(spark, "song_json")
    d.select(F.col("source").alias("artist"), F.array(song).alias("songs")).write.mode("overwrite").json(path)
    s = FS.read_song_json(spark, path)
    return s.select("doc_artist", "title", "album", "artist", F.md5("lyrics").alias("lyrics_md5"))


@query("text_paths", f"""
SELECT CAST(doc_id AS VARCHAR) AS msd_id, 'data/lyrics/txt/' || {_FN} || '.txt' AS path FROM documents""")
def q_text_paths(spark, sf):
    """lyric file path of every song."""
    m = song_mapping(spark, sf)
    return m.select("msd_id", TX.text_path("data/lyrics/txt", TX.safe_file_name(
        F.col("msd_artist"), F.col("msd_title"))).alias("path"))


_KNOWN_BAD_SQL = "WITH " + _MAPPING_SQL + """,
bad AS (SELECT DISTINCT msd_id, msd_artist, msd_title, mxm_id, mxm_artist, mxm_title FROM mapping WHERE p_size <= 5)
SELECT m.msd_id, m.msd_artist, m.msd_title, m.mxm_id, m.mxm_artist, m.mxm_title FROM mapping m
WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.msd_id IS NOT DISTINCT FROM m.msd_id
  AND b.msd_artist IS NOT DISTINCT FROM m.msd_artist AND b.msd_title IS NOT DISTINCT FROM m.msd_title
  AND b.mxm_id IS NOT DISTINCT FROM m.mxm_id AND b.mxm_artist IS NOT DISTINCT FROM m.mxm_artist
  AND b.mxm_title IS NOT DISTINCT FROM m.mxm_title)"""


@query("known_bad_antijoin", _KNOWN_BAD_SQL)
def q_known_bad_antijoin(spark, sf):
    """Mapping rows equal in all six columns to a known-bad row are skipped."""
    m = _mapping_from_part(spark, sf)
    bad = m.where(F.col("p_size") <= 5).select(*FS.MAPPING_COLUMNS)
    return LK.drop_known_bad(m.select(*FS.MAPPING_COLUMNS), bad)


@query("already_have_antijoin", f"""
SELECT CAST(doc_id AS VARCHAR) AS msd_id, {_FN} AS lyrics_filename FROM documents WHERE lang <> 'en'""")
def q_already_have_antijoin(spark, sf):
    """Songs whose lyric file is not in the corpus listing yet."""
    songs = song_mapping(spark, sf).select(
        "msd_id", TX.safe_file_name(F.col("msd_artist"), F.col("msd_title")).alias("lyrics_filename"))
    listing = lyric_corpus(spark, sf).where(F.col("lang") == "en").select("lyrics_filename")
    return LK.missing_files(songs, listing)


_CATALOGUE_SQL = "WITH " + _MAPPING_SQL + """,
cat AS (SELECT CASE p_size % 4 WHEN 0 THEN msd_title WHEN 1 THEN msd_title WHEN 2 THEN mxm_title ELSE mxm_title END AS title,
               CASE p_size % 4 WHEN 0 THEN msd_artist WHEN 1 THEN mxm_artist WHEN 2 THEN msd_artist ELSE mxm_artist END AS artist,
               'C' || mxm_id AS catalogue_id
        FROM mapping WHERE p_size <= 25),
cand AS (SELECT msd_id, 1 AS prio, msd_title AS title, msd_artist AS artist FROM mapping
         UNION ALL SELECT msd_id, 2, msd_title, mxm_artist FROM mapping WHERE msd_artist <> mxm_artist
         UNION ALL SELECT msd_id, 3, mxm_title, msd_artist FROM mapping WHERE msd_title <> mxm_title
         UNION ALL SELECT msd_id, 4, mxm_title, mxm_artist FROM mapping WHERE msd_title <> mxm_title AND msd_artist <> mxm_artist),
hits AS (SELECT c.msd_id, c.prio, k.catalogue_id,
                row_number() OVER (PARTITION BY c.msd_id ORDER BY c.prio, k.catalogue_id) AS r
         FROM cand c JOIN cat k ON c.title = k.title AND c.artist = k.artist),
found AS (SELECT msd_id, prio, catalogue_id FROM hits WHERE r = 1)"""


def _catalogue(spark, sf):
    m = _mapping_from_part(spark, sf)
    sel = F.col("p_size") % 4
    return m.where(F.col("p_size") <= 25).select(
        F.when(sel <= 1, F.col("msd_title")).otherwise(F.col("mxm_title")).alias("title"),
        F.when(sel.isin(0, 2), F.col("msd_artist")).otherwise(F.col("mxm_artist")).alias("artist"),
        F.concat(F.lit("C"), F.col("mxm_id")).alias("catalogue_id"))


@query("fallback_lookup", _CATALOGUE_SQL + "\nSELECT msd_id, prio, catalogue_id FROM found")
def q_fallback_lookup(spark, sf):
    """Catalogue lookup under up to four spellings, first hit wins."""
    found, _ = LK.fallback_lookup(_mapping_from_part(spark, sf).select(*FS.MAPPING_COLUMNS),
                                  _catalogue(spark, sf))
    return found


@query("append_rejects", _CATALOGUE_SQL + """,
misses AS (SELECT m.msd_id, m.msd_artist, m.msd_title FROM mapping m WHERE m.msd_id NOT IN (SELECT msd_id FROM found))
SELECT * FROM misses UNION ALL SELECT * FROM misses""")
def q_append_rejects(spark, sf):
    """The misses of two lookup runs appended to one reject log."""
    path = _scratch(spark, "rejects")
    for _ in range(2):
        _, misses = LK.fallback_lookup(_mapping_from_part(spark, sf).select(*FS.MAPPING_COLUMNS),
                                       _catalogue(spark, sf))
        SK.write_table(misses.select("msd_id", "msd_artist", "msd_title"), path, append=True)
    return spark.read.parquet(path)


@query("stage_reuse", "WITH " + _VOCAB_SQL + "\nSELECT word_id, word, CAST(n AS BIGINT) AS n FROM vocab")
def q_stage_reuse(spark, sf):
    """The vocabulary materialised as a keyed stage; the second request
    reads the stored stage instead of rebuilding it."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")

    def build():
        return V.vocabulary(V.batch_counts(d, TX.preprocess(F.col("text"), "treebank")), VOCAB_SIZE)

    params = {"sf": sf, "vocab_size": VOCAB_SIZE, "tokenizer": "treebank"}
    root = _scratch(spark, "stages")
    SK.stage(spark, "vocabulary", params, build, root=root)
    return SK.stage(spark, "vocabulary", params, build, root=root)


@query("vocabulary_file", "WITH " + _VOCAB_SQL + "\nSELECT word_id, word FROM vocab")
def q_vocabulary_file(spark, sf):
    """Vocabulary written one word per line in id order and read back."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    vocab = V.vocabulary(V.batch_counts(d, TX.preprocess(F.col("text"), "treebank")), VOCAB_SIZE)
    path = _scratch(spark, "vocab_file")
    SK.write_vocabulary_file(vocab, path)
    return SK.read_vocabulary_file(spark, path).select(F.col("word_id").cast("int").alias("word_id"), "word")


@query("confusion_csv_roundtrip", _CM_SQL + "\nSELECT label, prediction, n FROM cm")
def q_confusion_csv_roundtrip(spark, sf):
    """A wide confusion CSV with a row-index column, read back long."""
    classes = ["bad", "good"]
    wide = ME.confusion_wide(ME.confusion_long(_pairs(spark, sf)), classes)
    idx = F.when(F.col("label") == classes[0], 0).otherwise(1)
    out = wide.select(idx.alias("_row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(classes)])
    path = _scratch(spark, "confusion_csv")
    SK.write_table(out.coalesce(1), path, fmt="csv", overwrite=True, header=True)
    return FS.read_confusion_csv(spark, path, classes)


@query("step_log", """
SELECT event_type AS dataset, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, event_id AS step, value AS loss,
       CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS acc FROM events""")
def q_step_log(spark, sf):
    """Step-log rows appended per dataset, then read back."""
    e = read_table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.col("event_id").alias("step"), F.col("value").alias("loss"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("acc"))
    path = _scratch(spark, "step_log")
    first = F.col("dataset").eqNullSafe("click")
    SK.append_step_log(e.where(first), path)
    SK.append_step_log(e.where(~first), path)
    return spark.read.parquet(path)
