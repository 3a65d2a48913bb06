"""Queries opN_<name> of the training-data operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import (
    divergence,
    graphsearch,
    linededup,
    piecetable,
    privacy,
    secrets,
    segmentsearch,
    sentpiece,
    sharding,
    simhash,
    stringkernel,
    tiling,
    urls,
)
from cadenza.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with merge-dropout, decoded again and compared."""
    return sentpiece.encode(table(spark, sf_dir, "documents"))


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints over 3-word shingles, classes linked at 2 or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=2)


@query("op4_pii_sanitise")
def op4_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, and the terms near it that give it away."""
    return privacy.digest(privacy.find(table(spark, sf_dir, "documents")))


@query("op5_lpt_sharding")
def op5_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, equal texts together, by longest-processing-time scheduling."""
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op6_url_reputation", urls.ORACLE)
def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url by rule, else by its host's reputation; a page's outcome is the label of the same number."""
    outcomes = table(spark, sf_dir, "labels").where("quality IS NOT NULL OR toxic = 1").select(
        F.col("doc_id").alias("page_id"), F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END").alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, with weak credential parts linked to their complements."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by Nyström string-kernel ridge regression."""
    return stringkernel.identify(table(spark, sf_dir, "documents"))


@query("op9_line_dedup", linededup.ORACLE)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with cross-site boilerplate lines removed."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, by greedy string tiling, with each item's coverage."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_words", "matched", "coverage")


@query("op10_graph_search")
def op10_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products for every 20th vector, by beam search on robust-pruned graphs."""
    return graphsearch.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query("op11_segment_search", segmentsearch.ORACLE)
def op11_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products for every 50th vector, exact, pruned by segment statistics."""
    return segmentsearch.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query("op12_fill_in_middle", piecetable.ORACLE)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text rearranged for filling in the middle, and restored from the output alone."""
    return piecetable.restore(piecetable.fill_in_middle(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("op13_source_divergence", divergence.ORACLE)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language over all its kept terms, and each source's typical terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))
