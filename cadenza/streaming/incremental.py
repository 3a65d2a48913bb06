"""Structured Streaming forms of the two incremental behaviours.

R1 incremental index: new mapping files arrive in a folder; every
micro-batch is indexed against the static corpus (stream-static join) and
written idempotently (one output folder per batch id, overwritten on a
retry), so a re-run after a failure never duplicates rows. Rows already
indexed are skipped by the checkpointed file source itself.

R2 running scoreboard: tag rows stream in; each is scored through a
stream-static join with the per-tag deltas, stored once, and summed per (song, mood)
in the state store. A batch touches the songs of its own rows only and writes
nothing but its state; the board is read from the state store of the last
batch and equals the batch scoreboard.

Checkpoints and outputs live under the shared folder
(``spark.checkpoint.dir``). ``trigger(availableNow=True)`` processes what
is there in bounded micro-batches and stops, which is how a scheduled job
runs a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators import tags as TG
from cadenza.operators.lexicon import Lexicon
from cadenza.sources.sinks import discard, materialise
from cadenza.plans.index import corpus_stats, index_songs

MAPPING_STREAM_SCHEMA = T.StructType([
    T.StructField("msd_id", T.StringType()),
    T.StructField("msd_artist", T.StringType()),
    T.StructField("msd_title", T.StringType()),
])

TAG_STREAM_SCHEMA = T.StructType([
    T.StructField("tid_id", T.LongType()),
    T.StructField("tag_id", T.LongType()),
    T.StructField("val", T.DoubleType()),
])


def _files(spark: SparkSession, schema: T.StructType, path: str, files_per_batch: int | None) -> DataFrame:
    """Parquet files of a folder as a stream; a batch takes all new files unless the caller sets a number."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def incremental_index(spark: SparkSession, mapping_dir: str, corpus: DataFrame, out_dir: str,
                      checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Run R1 over everything in ``mapping_dir`` and return the indexed table."""
    stream = _files(spark, MAPPING_STREAM_SCHEMA, mapping_dir, files_per_batch)
    # language, words and presence of every text are worked out once; each
    # micro-batch joins this narrow table, not the texts
    stats = materialise(corpus_stats(corpus), "corpus-stats")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        indexed = index_songs(batch, stats=stats)
        indexed.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir).drop("batch")


def running_scoreboard(spark: SparkSession, tag_rows_dir: str, tags: DataFrame, tids: DataFrame,
                       lex: Lexicon, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Run R2 over the new tag rows in ``tag_rows_dir``; return the running
    state ``(tid_id, mood, score)``. A later call with the same checkpoint goes
    on where the last one, or a failed one, ended."""
    deltas = materialise(TG.tag_deltas(tags, lex).select("tag_id", "mood", "delta"), "tag-deltas")
    stream = _files(spark, TAG_STREAM_SCHEMA, tag_rows_dir, files_per_batch)
    scored = stream.join(tids.select("tid_id"), "tid_id").join(deltas, "tag_id")
    board = scored.groupBy("tid_id", "mood").agg(F.sum("delta").cast("long").alias("score"))
    q = (board.writeStream.outputMode("update").format("noop")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    discard(deltas)
    return scoreboard_state(spark, checkpoint)


def scoreboard_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(tid_id, mood, score)``: the sums in the state store of the last finished batch, each key once."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.tid_id", "key.mood", F.col("value")[state.schema["value"].dataType.names[0]].alias("score"))
