"""File sources (S1-S7, S11, S17) with explicit schemas - no inference.

Every reader is a plain ``spark.read`` with a fixed schema; text formats
that need parsing (``<SEP>`` lines, encodings) are parsed with column
expressions right after the scan.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAPPING_COLUMNS = ["msd_id", "msd_artist", "msd_title", "mxm_id", "mxm_artist", "mxm_title"]
MAPPING_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in MAPPING_COLUMNS])

INDEXED_SCHEMA = T.StructType(MAPPING_SCHEMA.fields + [
    T.StructField("is_english", T.IntegerType()),
    T.StructField("lyrics_available", T.IntegerType()),
    T.StructField("wordcount", T.IntegerType()),
    T.StructField("lyrics_filename", T.StringType()),
])

# The nine training columns and their fixed types.
TRAINING_SCHEMA = T.StructType([
    T.StructField("msd_id", T.StringType()),
    T.StructField("msd_artist", T.StringType()),
    T.StructField("msd_title", T.StringType()),
    T.StructField("is_english", T.IntegerType()),
    T.StructField("lyrics_available", T.IntegerType()),
    T.StructField("wordcount", T.IntegerType()),
    T.StructField("lyrics_filename", T.StringType()),
    T.StructField("mood", T.StringType()),
    T.StructField("matched_mood", T.IntegerType()),
])

GENRE_SCHEMA = T.StructType([T.StructField("msd_id", T.StringType()),
                             T.StructField("magd_genre", T.StringType())])

SONG_JSON_SCHEMA = T.StructType([
    T.StructField("artist", T.StringType()),
    T.StructField("songs", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("album", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("lyrics", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("json", T.StringType()),
    ]))),
])

SEP = "<SEP>"


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType = TRAINING_SCHEMA,
                   usecols: list[str] | None = None) -> DataFrame:
    """Header CSV with a fixed schema; ``usecols`` prunes columns
    (Catalyst pushes the projection into the CSV scan)."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*usecols) if usecols else df


def read_genre_tsv(spark: SparkSession, path: str) -> DataFrame:
    """S3: headerless tab-separated ``msd_id, magd_genre``."""
    return spark.read.schema(GENRE_SCHEMA).option("sep", "\t").option("header", False).csv(path)


#: Characters that a line is stripped of at either end: everything that counts as white space in Unicode.
WHITE = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                                 0x202F, 0x205F, 0x3000])


def parse_sep_lines(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``#`` comment lines skipped, lines stripped and split on ``<SEP>``.
    Returns (rows with six columns, rejects = lines without six fields)."""
    body = lines.where(~F.col(col).startswith("#")).select(F.trim(F.col(col), F.lit(WHITE)).alias("_line"))
    parts = body.select("_line", F.split("_line", SEP, -1).alias("_p"))
    ok = parts.where(F.size("_p") == 6).select(
        *[F.col("_p")[i].alias(c) for i, c in enumerate(MAPPING_COLUMNS)])
    rejects = parts.where(F.size("_p") != 6).select(F.col("_line").alias("line"),
                                                    F.size("_p").alias("n_fields"))
    return ok, rejects


def read_sep_mapping(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_sep_lines(spark.read.text(path))


#: Paths that a task hands on at a time, and bytes of contents.
PATHS, CONTENTS = 4096, 4 << 20
#: A glob that means the same to Hadoop and to ``fnmatch``, and paths without one.
_PLAIN_GLOB, _GLOB = re.compile(r"[^\\{}\[\]^]*"), re.compile(r"[*?{}\[\]\\]")


def _listed(base: str, glob: str | None) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in a folder and Spark's readers would look at; files as ``glob`` has them."""
    with os.scandir(base) as found:
        for e in found:
            n = e.name
            if n.startswith(".") or n.endswith("._COPYING_"):
                continue
            if n.startswith("_") and "=" not in n and not (n.startswith(("_metadata", "_common_metadata")) and e.is_dir()):
                continue
            if e.is_dir():
                yield e.path, True
            elif glob is None or fnmatchcase(n, glob):
                yield e.path, False


def _paths(paths: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, bool]] = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([d for _, d in held], pa.bool_())],
                                          names=["path", "folder"])

    for x in paths:
        held.append(x)
        if len(held) >= PATHS:
            yield out()
            held.clear()
    yield out()


def _local_files(spark: SparkSession, base: str, glob: str) -> DataFrame:
    """``(path, content)`` of the files below a folder on a local or mounted disk, which the tasks list and read.

    One task reads the names in the folder itself, many walk what is below its folders, and the paths are dealt anew before they are read:
    no list of the files is ever whole in a place, and a task holds ``PATHS`` names and ``CONTENTS`` bytes, or one file."""

    def top(batches):
        for b in batches:
            yield from _paths(x for _ in range(b.num_rows) for x in _listed(base, glob))

    def below(batches):
        def walk(path):
            for p, folder in _listed(path, glob):
                if folder:
                    yield from walk(p)
                else:
                    yield p, False

        for b in batches:
            yield from _paths(x for p, folder in zip(*(c.to_pylist() for c in b.columns)) for x in (walk(p) if folder else [(p, False)]))

    def read(batches):
        for b in batches:
            paths, held, size = b.column(0).to_pylist(), [], 0
            for i, p in enumerate(paths):
                with open(p, "rb") as f:
                    data = f.read()
                if data:  # Spark's readers skip empty files
                    held.append((f"file:{p}", data))
                    size += len(data)
                if size >= CONTENTS or i + 1 == len(paths):
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([x for _, x in held], pa.binary())],
                                                      names=["path", "content"])
                    held, size = [], 0

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return (spark.range(0, 1, 1, 1).mapInArrow(top, "path string, folder boolean").repartition(parts, "path")
            .mapInArrow(below, "path string, folder boolean").repartition(parts, "path").select("path")
            .mapInArrow(read, "path string, content binary"))


def read_text_corpus(spark: SparkSession, path: str, glob: str = "*.txt",
                     name_pattern: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """One text file per song -> ``(lyrics_filename, lyrics, encoding)``.

    A UTF-16 byte-order mark selects UTF-16; otherwise valid UTF-8 is
    decoded as UTF-8; anything else gives NULL lyrics and encoding 'none'.

    On a local or mounted disk the tasks list the files, as the driver's list of them would grow with the corpus; other
    file systems, and globs beyond ``*`` and ``?``, take Spark's reader, whose list the driver holds."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file" and not _GLOB.search(path) and _PLAIN_GLOB.fullmatch(glob) and fs.exists(root) and fs.getFileStatus(root).isDirectory():
        raw = _local_files(spark, fs.makeQualified(root).toUri().getPath(), glob)
    else:
        raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
               .option("recursiveFileLookup", True).load(path))
    head = F.hex(F.substring("content", 1, 2))
    as_str = F.col("content").cast("string")
    enc = (F.when(head.isin("FFFE", "FEFF"), F.lit("utf-16"))
           .when(F.is_valid_utf8(as_str), F.lit("utf-8")).otherwise(F.lit("none")))
    text = (F.when(enc == "utf-16", F.decode("content", "UTF-16"))
            .when(enc == "utf-8", as_str))
    name = F.regexp_extract("path", name_pattern, 1)
    return raw.select(name.alias("lyrics_filename"), text.alias("lyrics"), enc.alias("encoding"))


def read_song_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Song JSON documents -> one row per song (``inline`` of songs)."""
    df = spark.read.schema(SONG_JSON_SCHEMA).option("multiLine", multiline).json(path)
    return df.select(F.col("artist").alias("doc_artist"), F.inline("songs"))


def read_confusion_csv(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """A confusion CSV whose first column is a row index and whose other
    columns are the predicted classes in order -> long ``(label, prediction, n)``."""
    k = len(classes)
    schema = T.StructType([T.StructField("_row", T.IntegerType())] +
                          [T.StructField(f"c{i}", T.LongType()) for i in range(k)])
    df = spark.read.schema(schema).option("header", True).csv(path)
    names = F.array(*[F.lit(c) for c in classes])
    pairs = ", ".join(f"{i}, c{i}" for i in range(k))
    long = df.selectExpr("_row", f"stack({k}, {pairs}) AS (_col, n)")
    return long.where(F.col("_row").isNotNull()).select(
        F.element_at(names, F.col("_row") + 1).alias("label"),
        F.element_at(names, F.col("_col") + 1).alias("prediction"), "n")
