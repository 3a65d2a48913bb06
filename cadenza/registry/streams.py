"""Streaming queries: the final state of each stream equals the batch result
(R1 = index_documents, R2 = tag_scoreboard)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadenza.registry.base import query
from cadenza.registry.songs import _index_sql
from cadenza.registry.tagging import _BASE, PROBE
from cadenza.session import scratch_path
from cadenza.sources.songs import lyric_corpus, song_mapping
from cadenza.sources.tables import tag_store
from cadenza.streaming.incremental import incremental_index, running_scoreboard


def _run_dir(spark, name):
    return scratch_path(spark, "streams", name, uuid.uuid4().hex)


@query("stream_index_final", _index_sql(None))
def q_stream_index_final(spark, sf):
    """Mapping files streamed through the index in micro-batches."""
    root = _run_dir(spark, "index")
    # the mapping lands as several files to stream over, two at a time here
    song_mapping(spark, sf).repartition(spark.sparkContext.defaultParallelism, "msd_id").write.parquet(f"{root}/in")
    return incremental_index(spark, f"{root}/in", lyric_corpus(spark, sf), f"{root}/out",
                             f"{root}/ckpt", files_per_batch=2)


@query("stream_scoreboard_final", "WITH " + _BASE + "\nSELECT tid_id, mood, score FROM board")
def q_stream_scoreboard_final(spark, sf):
    """R2: tag rows streamed into a running (song, mood) scoreboard, in two runs: the second goes on with the files
    that came after the first."""
    root = _run_dir(spark, "scoreboard")
    store = tag_store(spark, sf)
    rows = store.tid_tag.select("tid_id", "tag_id", "val")
    early = F.pmod(F.xxhash64("tid_id", "tag_id"), F.lit(2)) == 0
    for some in (rows.where(early), rows.where(~early)):
        some.repartition(spark.sparkContext.defaultParallelism, "tid_id").write.mode("append").parquet(f"{root}/in")
        out = running_scoreboard(spark, f"{root}/in", store.tags, store.tids, PROBE, f"{root}/ckpt", files_per_batch=4)
    return out.select("tid_id", "mood", F.col("score").cast("long").alias("score"))
