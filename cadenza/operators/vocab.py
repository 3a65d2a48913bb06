"""Token streams, word counts and the vocabulary.

A token stream is ``(doc_id, pos, word)``: one row per token, produced by
``posexplode`` next to the scan, so no document is ever gathered anywhere.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.text import PAD
from cadenza.sources.sinks import discard, materialise

UNKNOWN_WORD = "UNK"


def token_stream(docs: DataFrame, tokens: Column, doc_col: str = "doc_id",
                 drop_pad: bool = True, keep_empty: bool = False) -> DataFrame:
    """flatten per-document token arrays to ``(doc_id, pos, word)``.
    ``<PAD>`` tokens are dropped (the stream is for counting and training).
    ``keep_empty`` keeps a document without tokens as one row of NULLs."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    s = docs.select(F.col(doc_col).alias("doc_id"), explode(tokens).alias("pos", "word"))
    return s.where(F.col("word").isNull() | (F.col("word") != PAD)) if drop_pad else s


def document_counts(docs: DataFrame, tokens: Column, doc_col: str = "doc_id") -> DataFrame:
    """``(doc_id, word, n, pos)``: each document's words, how often and where
    first; a document without tokens has one row of NULLs (n = 0).

    The documents are dealt by id before they are exploded: no exchange of
    token rows."""
    d = docs.select(F.col(doc_col).alias("doc_id"), tokens.alias("_t")).repartition("doc_id")
    s = d.select("doc_id", F.posexplode_outer("_t").alias("pos", "word"))
    return s.groupBy("doc_id", "word").agg(F.count("word").alias("n"), F.min("pos").alias("pos"))


#: Words that a Python task counts at a time.
STACK = 1 << 18


def stacks(column: int, limit: int = STACK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts Arrow batches so that the lists of ``column`` hold ``limit`` items together at most, or are a single row.

    A function of its own goes to the tasks with what calls it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            end, a = np.cumsum(size), 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + limit, "right")))
                yield b.slice(a, z - a)
                a = z

    return cut


def batch_counts(docs: DataFrame, tokens: Column, doc_col: str = "doc_id", drop_pad: bool = True) -> DataFrame:
    """``(doc_id, word, n, pos)``: the words of a stack of documents, how often, and where first by (doc_id, pos).

    As ``vocabulary`` takes it: the words are counted before they become rows, so a stack hands on its distinct words only.
    A stack is a part of an Arrow batch with about ``STACK`` words at most."""
    doc, cut = docs.schema[doc_col].dataType, stacks(1)

    def run(batches):
        for b in cut(batches):
            order = pc.sort_indices(b.column(0), null_placement="at_end")
            ids, rows = b.column(0).take(order), b.column(1).take(order)
            flat = rows.flatten().cast(pa.string())
            size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(size) - size
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            first = np.zeros(len(coded.dictionary), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]  # the earliest place is written last
            row = np.repeat(np.arange(len(size)), size)[first]
            n = np.bincount(code, minlength=len(first))
            out = pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), coded.dictionary, pa.array(n, pa.int64()), pa.array(first - begin[row], pa.int32())],
                names=["doc_id", "word", "n", "pos"])
            yield out.filter(pc.not_equal(coded.dictionary, PAD)) if drop_pad else out

    return docs.select(F.col(doc_col).alias("doc_id"), tokens.alias("_t")).mapInArrow(
        run, f"doc_id {doc.simpleString()}, word string, n long, pos int")


def word_frequency(stream: DataFrame) -> DataFrame:
    """A3: ``(word, n)`` over the whole stream (partial aggregation map-side)."""
    return stream.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _first_seen(stream: DataFrame) -> Column:
    """Orderable first-appearance key ``(doc_id, pos)`` of a token row.

    For integral document ids it is the exact number ``doc_id * 2^32 + pos``
    as a decimal, which holds every long and position and keeps the count +
    min aggregate a hash aggregate; other id types use a struct."""
    if isinstance(stream.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        return (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")
                + F.col("pos").cast("decimal(10,0)"))
    return F.struct("doc_id", "pos")


def vocabulary(stream: DataFrame, vocab_size: int) -> DataFrame:
    """``(word_id, word, n)``; id 0 is 'UNK' with the count of tokens
    outside the vocabulary, then the ``vocab_size - 1`` most frequent words,
    ties by first appearance ``(doc_id, pos)``.

    ``stream`` may be counted already: rows ``(doc_id, word, n, pos)`` with
    the word's first position in the document. The ranking is a distributed
    top-k (TakeOrderedAndProject) of size vocab_size - 1; only that bounded
    result gets a row_number. The counts of the distinct words are stored, as three branches read them. Every distinct word is shuffled once; ``frequent_vocabulary`` shuffles candidates only."""
    n = F.sum("n") if "n" in stream.columns else F.count(F.lit(1))
    counts = materialise(stream.groupBy("word").agg(n.alias("n"), F.min(_first_seen(stream)).alias("first")), "word-counts")
    top = counts.orderBy(F.desc("n"), F.asc("first")).limit(vocab_size - 1)
    ranked = top.select(
        F.row_number().over(Window.orderBy(F.desc("n"), F.asc("first"))).cast("int").alias("word_id"),
        "word", "n")
    # UNK count = all tokens - tokens of kept words. Both sums read the word
    # counts, so the text is tokenised once.
    both = (counts.select(F.col("n").cast("long").alias("_d"))
            .unionByName(ranked.select((-F.col("n")).cast("long").alias("_d"))))
    unk = both.agg(F.sum("_d").alias("n")).select(
        F.lit(0).alias("word_id"), F.lit(UNKNOWN_WORD).alias("word"), "n")
    return unk.unionByName(ranked)


#: Rows and columns of the count sketch, and how many words beyond the vocabulary's size a task may hold while it counts.
SKETCH_ROWS, SKETCH_COLUMNS, HELD = 4, 1 << 18, 1 << 16


def _sketch_columns(word: Column, columns: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(r), word), F.lit(columns)).cast("int") for r in range(SKETCH_ROWS)]


def count_sketch(counts: DataFrame, columns: int = SKETCH_COLUMNS) -> DataFrame:
    """``(r, c, s)``: count-min sums of ``(word, n)`` rows, at most ``SKETCH_ROWS * columns`` rows whatever the words.

    A word's count is at most the least of its sums."""
    cells = F.array(*[F.struct(F.lit(r).alias("r"), c.alias("c")) for r, c in enumerate(_sketch_columns(F.col("word"), columns))])
    return counts.select(F.explode(cells).alias("x"), "n").groupBy("x.r", "x.c").agg(F.sum("n").alias("s"))


def frequent_vocabulary(stream: DataFrame, vocab_size: int, columns: int = SKETCH_COLUMNS) -> DataFrame:
    """W3, the rows of ``vocabulary``, by a count-min sketch and an exact recount of its candidates.

    1. Tasks count their own words and add them to the sketch; only its sums are shuffled, a table of fixed size.
    2. A sample decides the threshold: the exact counts of the ``vocab_size - 1`` words that the sketch ranks first
       among a task-wise list of frequent words. Their smallest count is a lower bound of the true cut: that many words reach it.
    3. Every word whose sketch estimate reaches the bound is a candidate. An estimate is never below the count, so all words of the
       true vocabulary are candidates; they alone are shuffled, counted exactly and ranked.

    ``stream`` holds ``(doc_id, pos, word)`` or counted rows ``(doc_id, word, n, pos)`` and is read three times, so it should be stored.
    """
    spark = stream.sparkSession
    n = F.col("n") if "n" in stream.columns else F.lit(1)
    rows = stream.where("word IS NOT NULL").select("word", n.cast("long").alias("n"), _first_seen(stream).alias("first"))
    sums = materialise(count_sketch(rows.select("word", "n"), columns), "sketch")
    table = np.zeros((SKETCH_ROWS, columns), np.int64)  # of fixed size
    got = sums.toArrow()
    table[got["r"].to_numpy(), got["c"].to_numpy()] = got["s"].to_numpy()
    discard(sums)
    shared = spark.sparkContext.broadcast(table)
    keep = max(1, vocab_size - 1)

    @F.arrow_udf("long")
    def estimate(*places: pa.Array) -> pa.Array:
        found = [shared.value[r][c.to_numpy(zero_copy_only=False)] for r, c in enumerate(places)]
        return pa.array(np.min(found, axis=0), pa.int64())

    def likely(batches):
        """The words of this task that the sketch ranks first: a list of bounded length."""
        best: dict[str, int] = {}
        for b in batches:
            best.update(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            if len(best) > keep + HELD:
                best = dict(heapq.nlargest(keep, best.items(), key=lambda x: x[1]))
        top = heapq.nlargest(keep, best.items(), key=lambda x: x[1])
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([e for _, e in top], pa.int64())],
                                         names=["word", "e"])

    guessed = rows.withColumn("e", estimate(*_sketch_columns(F.col("word"), columns)))
    first = (guessed.select("word", "e").mapInArrow(likely, "word string, e long").distinct()
             .orderBy(F.desc("e"), "word").limit(keep).select("word"))
    exact = rows.join(F.broadcast(first), "word").groupBy("word").agg(F.sum("n").alias("n"))  # vocab_size words at most
    cut = exact.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
    bound = cut["least"] if cut["k"] == keep else 0  # fewer words than asked for: all are candidates
    counts = (guessed.where(F.col("e") >= bound).groupBy("word").agg(F.sum("n").alias("n"), F.min("first").alias("first")))
    ranked = counts.orderBy(F.desc("n"), F.asc("first")).limit(vocab_size - 1).select(
        F.row_number().over(Window.orderBy(F.desc("n"), F.asc("first"))).cast("int").alias("word_id"), "word", "n")
    both = rows.select(F.col("n").alias("_d")).unionByName(ranked.select((-F.col("n")).alias("_d")))
    unk = both.agg(F.sum("_d").alias("n")).select(F.lit(0).alias("word_id"), F.lit(UNKNOWN_WORD).alias("word"), "n")
    return unk.unionByName(ranked)


def encode_stream(stream: DataFrame, vocab: DataFrame, pad_as_zero: bool = True) -> DataFrame:
    """J9 on a stream: ``(doc_id, pos, word_id)``; unknown words (and '<PAD>')
    map to 0, a NULL word (a document without tokens) to NULL. The size of
    the vocabulary decides the join at run time."""
    v = vocab.where(F.col("word_id") > 0).select("word", "word_id")
    return stream.join(v, "word", "left").select(
        "doc_id", "pos", F.when(F.col("word").isNotNull(), F.coalesce("word_id", F.lit(0))).alias("word_id"))


def encode_docs(docs: DataFrame, tokens: Column, vocab: DataFrame,
                doc_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Per document the ``keep`` columns and the id array (same length as the token array, empty
    for a document without tokens).

    The vocabulary, whose size is an option, goes to every task as one hash index, and
    an Arrow batch of token arrays is looked up at once: no token row is made, shuffled or gathered again."""
    known = vocab.where(F.col("word_id") > 0).select("word", F.col("word_id").cast("int").alias("word_id")).toArrow()
    shared = vocab.sparkSession.sparkContext.broadcast(
        (known["word"].combine_chunks().cast(pa.string()), known["word_id"].combine_chunks()))

    @F.arrow_udf("array<int>")
    def look_up(words: pa.Array) -> pa.Array:
        listed, ids = shared.value
        flat = words.values.cast(pa.string())
        at = pc.index_in(flat, value_set=listed)
        found = pc.fill_null(pc.take(ids, at), 0)
        return pa.ListArray.from_arrays(words.offsets, found, mask=words.is_null() if words.null_count else None)

    keep = list(keep or [])
    return docs.select(F.col(doc_col).alias("doc_id"), *keep, tokens.alias("_t")).select(
        "doc_id", *keep, F.coalesce(look_up(F.coalesce("_t", F.array().cast("array<string>"))), F.array().cast("array<int>")).alias("ids"))


def decode_stream(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(doc_id, pos, word_id)`` -> + word (reverse lookup)."""
    return ids.join(vocab.select("word_id", "word"), "word_id", "left")
