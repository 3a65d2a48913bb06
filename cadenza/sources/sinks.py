"""Sinks (S12-S16, S18) and the stage cache.

Outputs go to explicit paths; materialised stages and scratch outputs go
under the shared folder named by ``spark.checkpoint.dir`` (never a
machine-local temp dir on a cluster), so a lost executor never loses a
finished stage.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
import zlib
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import app_scratch, delete_path, scratch_path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False,
                append: bool = False, sort_by: list[str] | None = None,
                partitions: int | None = None, **options) -> None:
    """Write ``df``.

    * default mode refuses to replace existing output (the overwrite guard);
      ``overwrite=True`` replaces, ``append=True`` adds files;
    * ``sort_by`` gives globally ordered files: a range repartition on the
      keys (sampled bounds, no single-task sort) + sort inside partitions."""
    mode = "append" if append else ("overwrite" if overwrite else "errorifexists")
    out = df
    if sort_by:
        # without a number the shuffle's own partitioning, which follows the data's size
        by = ([partitions] if partitions else []) + list(sort_by)
        out = out.repartitionByRange(*by).sortWithinPartitions(*sort_by)
    w = out.write.mode(mode)
    for k, v in options.items():
        w = w.option(k, v)
    w.format(fmt).save(path)


def stage_key(name: str, params: dict) -> str:
    """Stage directory name: stage name + a digest of its parameters."""
    digest = hashlib.sha1(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]
    return f"{name}-{digest}"


def input_version(spark: SparkSession, path: str) -> str:
    """Digest of a file's or folder's listing (names, sizes, change times), so a
    stage key can follow its input. Reads no data."""
    p, fs = _fs(spark, path)
    files = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p))
    return hashlib.sha1(json.dumps(files).encode()).hexdigest()[:12]


#: Of stored tables: texts, tokens and counts take about two thirds of what they take in Spark's default.
COMPRESSION = "zstd"

#: Seconds for which a version that a newer one has replaced stays for those who still read it.
KEEP_S = 3600


def stage(spark: SparkSession, name: str, params: dict, build: Callable[[], DataFrame],
          reuse: bool = True, root: str | None = None, inputs: list[str] | None = None, keep_s: float = KEEP_S) -> DataFrame:
    """Materialise ``build()`` as Parquet under a parameter key and read
    it back; with ``reuse`` a published version is read instead of rebuilt.
    ``inputs`` are paths whose current listing is part of the key: changed
    input, another stage.

    Every build writes a folder of its own and is published by one new file
    next to it once it is complete. Runs of one key at the same time never touch each other's
    files, and a reader sees a whole version or none; the newest published one counts. Versions
    that were replaced, and builds never published, go after ``keep_s`` seconds."""
    base = root or scratch_path(spark, "stages")
    if inputs:
        params = {**params, "inputs": [input_version(spark, p) for p in inputs]}
    path = f"{base.rstrip('/')}/{stage_key(name, params)}"
    version = next(iter(_published(spark, path)), None) if reuse else None
    if version is None:
        version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        build().write.parquet(f"{path}/{version}", compression=COMPRESSION)
        _publish(spark, path, version, keep_s)
    return spark.read.parquet(f"{path}/{version}")


def _published(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions of a stage, the newest first: a name begins with the time of its publication."""
    root, fs = _fs(spark, f"{path}/_published")
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return [n.split("=", 1)[1] for n in sorted(names, reverse=True) if "=" in n]


def _publish(spark: SparkSession, path: str, version: str, keep_s: float) -> None:
    """The file that makes a complete version the newest, created in one step; then what nobody needs any more goes."""
    mark, fs = _fs(spark, f"{path}/_published/{time.time_ns():020d}={version}")
    fs.create(mark, False).close()
    newest, old = next(iter(_published(spark, path))), time.time() - keep_s
    root, _ = _fs(spark, path)
    for f in fs.listStatus(root):
        if f.getPath().getName().startswith("v-") and f.getPath().getName() != newest and f.getModificationTime() / 1000 < old:
            for m in fs.listStatus(_fs(spark, f"{path}/_published")[0]):  # unpublished first, so that nobody picks it now
                if m.getPath().getName().endswith("=" + f.getPath().getName()):
                    fs.delete(m.getPath(), False)
            fs.delete(f.getPath(), True)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Bytes of input for each core below which a stored table is dealt anew.
SMALL_INPUT = 64 << 20


#: Bytes of input, or of its texts once they are read, for each partition of ``deal``.
DEAL_BYTES, DEAL_TEXT = 4 << 20, 8 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, by the optimiser's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def deal(df: DataFrame, key: str, text_col: str | None = None) -> DataFrame:
    """``df`` dealt by ``key`` into partitions of about ``DEAL_BYTES`` of input: for texts that a task turns into many
    more bytes of counted rows, so that what it holds doesn't grow with the input. With ``text_col`` that column's own bytes
    decide (``DEAL_TEXT`` a partition), as files may hold far fewer bytes than their texts have."""
    if text_col:
        size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]
        parts = -(-size // DEAL_TEXT)
    else:
        parts = -(-input_bytes(df) // DEAL_BYTES)
    return df.repartition(min(max(df.sparkSession.sparkContext.defaultParallelism, parts), 1 << 16), key)


def materialise(df: DataFrame, name: str, spread: str | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: for
    an intermediate table that several branches of one plan read. ``discard``
    deletes it, ``session.clear_scratch`` all of the application's.
    ``partition_by``: a column of few values by which parts of the
    table are read.

    ``spread`` names a column by which the rows of a small input (fewer bytes
    than ``SMALL_INPUT`` for each core) are dealt first: it comes in fewer
    splits than there are cores. The rows are the same either way; a large
    input has splits enough and is written without a shuffle."""
    spark = df.sparkSession
    if spread:
        if input_bytes(df) < SMALL_INPUT * spark.sparkContext.defaultParallelism:
            df = df.repartition(spread)
    path = app_scratch(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path, partitionBy=partition_by, compression=COMPRESSION)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` gave and no plan reads any more."""
    delete_path(df.sparkSession, df._stored_at)


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write_vocabulary_file(vocab: DataFrame, path: str, overwrite: bool = True) -> None:
    """One word per line in id order. The vocabulary is bounded by its
    size parameter, so a single ordered file is written."""
    (vocab.orderBy("word_id").select("word").coalesce(1)
     .write.mode("overwrite" if overwrite else "errorifexists").text(path))


def read_vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """Read S16 back: line number = word id. The file is small (bounded by the
    vocabulary size), read whole as one row, and posexplode keeps line order."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n")
    return whole.select(F.posexplode(lines).alias("word_id", "word"))


#: Folders over which the files of a corpus are spread, so that they are listed side by side; Spark's name of a NULL folder.
FOLDERS, NO_NAME = 256, "__HIVE_DEFAULT_PARTITION__"
_UNSAFE = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{}\[\]^]""")


def write_text_corpus(df: DataFrame, path: str, name_col: str = "lyrics_filename", text_col: str = "lyrics") -> None:
    """One text file per name: ``path/folder=<f>/<name_col>=<name>/part-<task>.txt``, a line for each row of the name in a task.

    A file of its own for every row is dear where Hadoop makes it: on a local or mounted disk each one
    starts several processes (``chmod``), has a checksum file beside it and is moved once more by the driver. There the tasks write the
    files themselves: under a hidden name, which becomes the final one when the file is complete, so a task that
    runs again puts the same files in the place of its first ones. Other file systems take Spark's own writer."""
    rows = df.select(F.col(name_col).cast("string").alias("_name"), F.col(text_col).cast("string").alias("_text"))
    root, fs = _fs(df.sparkSession, path)
    if fs.getScheme() != "file":
        (rows.select(F.pmod(F.crc32(F.coalesce("_name", F.lit(""))), F.lit(FOLDERS)).alias("folder"), F.col("_name").alias(name_col), "_text")
         .write.mode("overwrite").partitionBy("folder", name_col).text(path))
        return
    if fs.exists(root):
        fs.delete(root, True)
    fs.mkdirs(root)
    base = str(root.toUri().getPath())

    def write(batches):
        task = TaskContext.get()
        end, hidden = f"part-{task.partitionId():05d}.txt", f".{task.taskAttemptId()}.txt.tmp"
        name, out, at = None, None, None
        for b in batches:
            for key, text in zip(*(c.to_pylist() for c in b.columns)):
                key = key or NO_NAME
                if out is None or key != name:
                    if out is not None:
                        out.close()
                        os.replace(f"{at}/{hidden}", f"{at}/{end}")
                    name = key
                    safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", key)
                    at = f"{base}/folder={zlib.crc32(key.encode()) % FOLDERS}/{name_col}={safe}"
                    os.makedirs(at, exist_ok=True)
                    out = open(f"{at}/{hidden}", "wb")
                out.write((text or b"") + b"\n")
        if out is not None:
            out.close()
            os.replace(f"{at}/{hidden}", f"{at}/{end}")
        yield from ()

    # rows of a name lie together in a task, as they do in Spark's writer
    rows.withColumn("_text", F.col("_text").cast("binary")).sortWithinPartitions("_name").mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()


def append_step_log(log: DataFrame, path: str) -> None:
    """Append ``(dataset, time, step, loss, acc)`` rows to the run log."""
    log.select("dataset", "time", "step", "loss", "acc").write.mode("append").parquet(path)
