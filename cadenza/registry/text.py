"""Text queries over ``documents``: tokenisers, preprocessing, word counts,
vocabulary and id encoding (F3, F5-F8, F11, F17, A3-A5, W3, J9, J10, L5, L7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as TX
from cadenza.operators import frames as FR
from cadenza.operators import vocab as V
from cadenza.registry.base import query
from cadenza.registry.sqlparts import preprocess_sql, word_count_sql
from cadenza.sources.sinks import materialise
from cadenza.sources.tables import read_table

VOCAB_SIZE = 1000


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "text")


def _tokens_sql(tok="treebank", remove_stop=True, remove_punc=True) -> str:
    return f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens_text
FROM (SELECT doc_id, {preprocess_sql('text', tok, remove_stop, remove_punc)} AS t FROM documents)"""


def _tokens_df(spark, sf, tok="treebank", remove_stop=True, remove_punc=True):
    d = _docs(spark, sf)
    t = TX.preprocess(F.col("text"), tok, remove_stop, remove_punc)
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                    F.array_join(t, " ").alias("tokens_text"))


@query("tokens_wordpunct", _tokens_sql("wordpunct"))
def q_tokens_wordpunct(spark, sf):
    """F6 + F7 + F17: word/punctuation tokens, stop words and punctuation removed."""
    return _tokens_df(spark, sf, "wordpunct")


@query("tokens_treebank", _tokens_sql("treebank"))
def q_tokens_treebank(spark, sf):
    """F5 + F7 + F17: Treebank tokens, stop words and punctuation removed."""
    return _tokens_df(spark, sf, "treebank")


@query("tokens_treebank_all", _tokens_sql("treebank", False, False))
def q_tokens_treebank_all(spark, sf):
    """Treebank tokens with stop words and punctuation kept."""
    return _tokens_df(spark, sf, "treebank", False, False)


@query("word_count", f"SELECT doc_id, {word_count_sql('text')} AS wordcount FROM documents")
def q_word_count(spark, sf):
    """white-space word count of every document."""
    return _docs(spark, sf).select("doc_id", TX.word_count(F.col("text")).alias("wordcount"))


@query("preprocess_padded", f"""
WITH c AS (SELECT CAST(floor(quantile_cont({word_count_sql('text')}, 0.75)) AS INTEGER) AS cutoff FROM documents),
t AS (SELECT doc_id, {preprocess_sql('text')} AS t FROM documents)
SELECT doc_id, c.cutoff,
       array_to_string(CASE WHEN len(t) >= c.cutoff THEN t[1:c.cutoff]
                            ELSE list_concat(t, list_transform(range(c.cutoff - len(t)), lambda x: '<PAD>')) END, ' ')
         AS tokens_text
FROM t, c""")
def q_preprocess_padded(spark, sf):
    """L5 with padding: tokens cut or padded to int(75th pct word count) (A13 + F8)."""
    d = _docs(spark, sf).withColumn("wordcount", TX.word_count(F.col("text")))
    cut = FR.length_cutoff(d, "wordcount")
    # one-row scalar attached by broadcast (no data-sized side is duplicated)
    d = d.join(F.broadcast(cut), on=F.lit(True), how="left_outer")
    t = TX.preprocess(F.col("text"), "treebank", do_padding=True, cutoff=F.col("cutoff"))
    return d.select("doc_id", "cutoff", F.array_join(t, " ").alias("tokens_text"))


_STREAM_SQL = f"""toks AS (SELECT doc_id, {preprocess_sql('text')} AS t FROM documents),
stream AS (SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS word FROM toks)"""

_VOCAB_SQL = _STREAM_SQL + f""",
counts AS (SELECT word, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS first FROM stream GROUP BY word),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS word_id, word, n
           FROM counts ORDER BY n DESC, first LIMIT {VOCAB_SIZE - 1}),
vocab AS (SELECT 0 AS word_id, 'UNK' AS word,
                 (SELECT count(*) FROM stream) - (SELECT coalesce(sum(n), 0) FROM ranked) AS n
          UNION ALL SELECT word_id, word, n FROM ranked)"""


def _stream(spark, sf):
    d = _docs(spark, sf)
    return V.token_stream(d, TX.preprocess(F.col("text"), "treebank"))


_WORDS_SQL = """WITH words AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+'),
                                             lambda w: w <> '')) AS word FROM documents)"""


def _words(spark, sf):
    """White-space words as they stand: case and stop words kept."""
    return V.token_stream(_docs(spark, sf), TX.whitespace_tokens(F.col("text")), drop_pad=False)


@query("word_frequency", _WORDS_SQL + "\nSELECT word, count(*) AS n FROM words GROUP BY word")
def q_word_frequency(spark, sf):
    """A3: white-space word frequencies over the whole corpus."""
    return V.word_frequency(_words(spark, sf))


@query("unique_words", _WORDS_SQL + "\nSELECT count(DISTINCT word) AS n_unique FROM words")
def q_unique_words(spark, sf):
    """A4: number of distinct white-space words."""
    return _words(spark, sf).agg(F.count_distinct("word").alias("n_unique"))


@query("token_frequency", "WITH " + _STREAM_SQL + "\nSELECT word, count(*) AS n FROM stream GROUP BY word")
def q_token_frequency(spark, sf):
    """A3 over the preprocessed tokens (lower-cased, without stop words)."""
    return V.word_frequency(_stream(spark, sf))


@query("documents_read", "SELECT count(*) FILTER (WHERE length(text) > 0) AS n_read, count(*) AS n_docs FROM documents")
def q_documents_read(spark, sf):
    """A5: documents that actually had content."""
    return _docs(spark, sf).agg(F.count_if(F.length("text") > 0).alias("n_read"),
                                F.count(F.lit(1)).alias("n_docs"))


@query("vocabulary", "WITH " + _VOCAB_SQL + "\nSELECT word_id, word, CAST(n AS BIGINT) AS n FROM vocab")
def q_vocabulary(spark, sf):
    """UNK + the 999 most frequent words, ties by first appearance."""
    return V.vocabulary(V.batch_counts(_docs(spark, sf), TX.preprocess(F.col("text"), "treebank")), VOCAB_SIZE)


@query("vocabulary_frequent", "WITH " + _VOCAB_SQL + "\nSELECT word_id, word, CAST(n AS BIGINT) AS n FROM vocab")
def q_vocabulary_frequent(spark, sf):
    """W3 by a count-min sketch: candidates by their upper bounds, then an exact recount of those alone."""
    d = read_table(spark, sf, "documents").select("doc_id", TX.preprocess(F.col("text"), "treebank").alias("t"))
    counts = materialise(V.document_counts(d, F.col("t")).where("word IS NOT NULL"), "document-counts")
    return V.frequent_vocabulary(counts, VOCAB_SIZE)


@query("encode_tokens", "WITH " + _VOCAB_SQL + """,
enc AS (SELECT s.doc_id, s.pos, coalesce(v.word_id, 0) AS word_id
        FROM stream s LEFT JOIN (SELECT * FROM vocab WHERE word_id > 0) v ON s.word = v.word)
SELECT d.doc_id, coalesce(e.ids_text, '') AS ids_text FROM documents d
LEFT JOIN (SELECT doc_id, array_to_string(list(word_id ORDER BY pos), ' ') AS ids_text FROM enc GROUP BY doc_id) e
ON d.doc_id = e.doc_id""")
def q_encode_tokens(spark, sf):
    """Per document the vocabulary ids (unknown -> 0), in token order; a
    document without tokens has none. Texts are tokenised once, into a stored table."""
    toks = materialise(_docs(spark, sf).select("doc_id", TX.preprocess(F.col("text"), "treebank").alias("tokens")), "tokens",
                       spread="doc_id")
    vocab = V.vocabulary(V.batch_counts(toks, F.col("tokens")), VOCAB_SIZE)
    enc = V.encode_docs(toks, F.col("tokens"), vocab)
    return enc.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids_text"))


@query("decode_tokens", "WITH " + _VOCAB_SQL + """,
enc AS (SELECT s.doc_id, s.pos, coalesce(v.word_id, 0) AS word_id
        FROM stream s LEFT JOIN (SELECT * FROM vocab WHERE word_id > 0) v ON s.word = v.word)
SELECT e.doc_id, e.pos, e.word_id, v.word FROM enc e LEFT JOIN vocab v ON e.word_id = v.word_id""")
def q_decode_tokens(spark, sf):
    """Ids back to words (unknown words come back as 'UNK')."""
    s = _stream(spark, sf)
    vocab = V.vocabulary(s, VOCAB_SIZE)
    return V.decode_stream(V.encode_stream(s, vocab), vocab).select("doc_id", "pos", "word_id", "word")
