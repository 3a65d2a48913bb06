"""Vector, pair and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as TX
from cadenza.operators import features as FE
from cadenza.operators import langid as LI
from cadenza.operators import pairs as PA
from cadenza.operators import sampling as S
from cadenza.operators import vectors as VE
from cadenza.operators import vocab as V
from cadenza.registry.base import query
from cadenza.registry.songs import _SPLIT_SQL
from cadenza.registry.text import _VOCAB_SQL, VOCAB_SIZE, _STREAM_SQL
from cadenza.sources.sinks import materialise
from cadenza.sources.tables import read_table

DIM = 64


def _emb(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", "embedding")


_DOT = "list_reduce(list_transform(range(1, {d} + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)), lambda x, y: x + y)"


def _dot_sql(a, b):
    return _DOT.format(d=DIM, a=a, b=b)


@query("l2_normalise", f"""
WITH n AS (SELECT vec_id, embedding, sqrt({_dot_sql('embedding', 'embedding')}) AS nrm FROM embeddings)
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
       round(CASE WHEN nrm > 0 THEN CAST(unnest(embedding) AS DOUBLE) / nrm ELSE 0.0 END, 6) AS value
FROM n""")
def q_l2_normalise(spark, sf):
    """every embedding divided by its L2 norm (long form)."""
    e = _emb(spark, sf)
    return e.select("vec_id", F.posexplode(VE.l2_normalise(F.col("embedding"))).alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@query("nearest_k", f"""
WITH probes AS (SELECT * FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 100)
                ORDER BY md5('42|' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 16),
s AS (SELECT p.vec_id AS probe_id, v.vec_id AS neighbour_id,
             {_dot_sql('p.embedding', 'v.embedding')} / (sqrt({_dot_sql('p.embedding', 'p.embedding')}) *
             sqrt({_dot_sql('v.embedding', 'v.embedding')})) AS sim
      FROM probes p JOIN embeddings v ON p.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, neighbour_id) AS rank FROM s)
SELECT probe_id, CAST(rank AS INTEGER) AS rank, neighbour_id, round(sim, 5) AS sim FROM r WHERE rank <= 8""")
def q_nearest_k(spark, sf):
    """J15 + W5: 8 nearest vectors by cosine for 16 seeded probes among the
    100 lowest ids; the whole table is scanned for every probe."""
    e = _emb(spark, sf)
    probes = VE.select_probes(e, "vec_id", 16, 100, 42)
    return VE.nearest_k(e, probes, "vec_id", "embedding", 8).select(
        "probe_id", "rank", "neighbour_id", F.round("sim", 5).alias("sim"))


@query("embedding_lookup", "WITH " + _VOCAB_SQL + f""",
enc AS (SELECT s.doc_id, s.pos, coalesce(v.word_id, 0) AS word_id
        FROM stream s LEFT JOIN (SELECT * FROM vocab WHERE word_id > 0) v ON s.word = v.word),
j AS (SELECT e.doc_id, m.embedding FROM enc e JOIN embeddings m ON e.word_id = m.vec_id),
p AS (SELECT doc_id, count(*) AS n_hits,
       {", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 5) AS e{i}" for i in range(DIM))}
      FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_hits, 0) AS n_hits, {", ".join(f"p.e{i}" for i in range(DIM))}
FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id""")
def q_embedding_lookup(spark, sf):
    """Token ids -> embedding rows, mean-pooled per document; a document
    without a hit stays. Texts are tokenised once, into a stored table."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    toks = materialise(d.select("doc_id", TX.preprocess(F.col("text"), "treebank").alias("tokens")), "tokens", spread="doc_id")
    vocab = V.vocabulary(V.batch_counts(toks, F.col("tokens")), VOCAB_SIZE)
    ids = V.encode_docs(toks, F.col("tokens"), vocab)
    pooled = VE.pool_ids(ids, F.col("ids"), _emb(spark, sf), "vec_id", "embedding", DIM, VOCAB_SIZE)
    return pooled.select("doc_id", "n_hits", *[F.round(F.col("e")[i], 5).alias(f"e{i}") for i in range(DIM)])


@query("embedding_lookup_join", "WITH " + _VOCAB_SQL + f""",
enc AS (SELECT s.doc_id, s.pos, coalesce(v.word_id, 0) AS word_id
        FROM stream s LEFT JOIN (SELECT * FROM vocab WHERE word_id > 0) v ON s.word = v.word),
j AS (SELECT e.doc_id, m.embedding FROM enc e JOIN embeddings m ON e.word_id = m.vec_id),
p AS (SELECT doc_id, count(*) AS n_hits,
       {", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 5) AS e{i}" for i in range(DIM))}
      FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_hits, 0) AS n_hits, {", ".join(f"p.e{i}" for i in range(DIM))}
FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id""")
def q_embedding_lookup_join(spark, sf):
    """J14 as a join, for vector tables of any size: counted (document, word) rows meet the vectors."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    counts = materialise(V.document_counts(d, TX.preprocess(F.col("text"), "treebank")), "words")
    vocab = V.vocabulary(counts.where(F.col("word").isNotNull()), VOCAB_SIZE).select("word", "word_id").where("word_id > 0")
    enc = counts.join(vocab, "word", "left").select(
        "doc_id", F.when(F.col("word").isNotNull(), F.coalesce("word_id", F.lit(0))).alias("word_id"), "n")
    pooled = VE.mean_pool(enc, _emb(spark, sf), "vec_id", "embedding", DIM)
    return pooled.select("doc_id", "n_hits", *[F.round(f"e{i}", 5).alias(f"e{i}") for i in range(DIM)])


_PAIRS_SQL = "WITH " + _STREAM_SQL + """,
offs AS (SELECT * FROM (VALUES (-1), (1)) t(o))
SELECT c.word AS centre, x.word AS context, count(*) AS n
FROM stream c JOIN offs ON TRUE JOIN stream x ON x.doc_id = c.doc_id AND x.pos = c.pos + offs.o
GROUP BY c.word, x.word"""


def _tokens(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d, TX.preprocess(F.col("text"), "treebank")


@query("skipgram_pairs", _PAIRS_SQL)
def q_skipgram_pairs(spark, sf):
    """W4 all-pairs mode (window 1 each side) as co-occurrence counts."""
    d, t = _tokens(spark, sf)
    return PA.counted_pairs(d, t, skip_window=1)


@query("skipgram_sampled", "WITH " + _STREAM_SQL + """,
lens AS (SELECT doc_id, count(*) AS n FROM stream GROUP BY doc_id),
offs AS (SELECT * FROM (VALUES (-2), (-1), (1), (2)) t(o)),
cand AS (SELECT c.doc_id, c.pos, c.word AS centre, c.pos + offs.o AS p
         FROM stream c JOIN offs ON TRUE JOIN lens l ON l.doc_id = c.doc_id
         WHERE c.pos + offs.o >= 0 AND c.pos + offs.o < l.n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY
             md5('42|' || CAST(doc_id AS VARCHAR) || '|' || CAST(pos AS VARCHAR) || '|' || CAST(p AS VARCHAR)), p) AS r
           FROM cand)
SELECT r.centre, x.word AS context, count(*) AS n
FROM ranked r JOIN stream x ON x.doc_id = r.doc_id AND x.pos = r.p WHERE r.r <= 2
GROUP BY r.centre, x.word""")
def q_skipgram_sampled(spark, sf):
    """W4 sampled mode: 2 of the 4 neighbours (window 2) per centre, seeded."""
    d, t = _tokens(spark, sf)
    return PA.counted_samples(d, t, skip_window=2, num_skips=2, seed=42)


_TERMS_SQL = """terms AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents)
  GROUP BY doc_id, term)"""


@query("term_counts", "WITH " + _TERMS_SQL + "\nSELECT doc_id, term, tf FROM terms")
def q_term_counts(spark, sf):
    """M1: term counts per document (runs of >= 2 word characters)."""
    return FE.term_counts(read_table(spark, sf, "documents"))


_TFIDF_SQL = "WITH " + _SPLIT_SQL + ",\n" + _TERMS_SQL + """,
tr AS (SELECT t.* FROM terms t JOIN split s ON t.doc_id = s.doc_id WHERE s.split = 'train'),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM split WHERE split = 'train')) / (1 + count(*))) + 1 AS idf
        FROM tr GROUP BY term),
w AS (SELECT t.doc_id, t.term, t.tf * i.idf AS w FROM terms t JOIN idf i ON t.term = i.term),
f AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""


def split_tfidf(spark, sf):
    """(split documents, features): idf fitted on the training split, applied to all; the texts are read once."""
    d = S.three_way_split(read_table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label")),
                          F.col("doc_id"), seed=42)
    keep = ["label", "split"]
    counts = materialise(FE.term_counts(d, keep=keep), "terms")
    n_docs = d.where("split = 'train'").agg(F.count(F.lit(1)).alias("n"))
    return d.drop("text"), FE.tfidf(counts, FE.fit_idf(counts.where("split = 'train'"), n_docs), keep)


def split_blocks(spark, sf, part=None, parts=1):
    """(split documents, their features in blocks), as ``split_tfidf``; every row of the training split is a training document."""
    d = S.three_way_split(read_table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label")),
                          F.col("doc_id"), seed=42).withColumn("is_train", F.col("split") == "train")
    return d.select("doc_id", "label", "split"), FE.block_tfidf(d, d.where("is_train").count(), part=part, parts=parts)


@query("tfidf", _TFIDF_SQL + "\nSELECT doc_id, term, round(tfidf, 5) AS tfidf FROM f")
def q_tfidf(spark, sf):
    """M2: TF-IDF with the idf fitted on the training split, applied to all."""
    return split_tfidf(spark, sf)[1].select("doc_id", "term", F.round("tfidf", 5).alias("tfidf"))


def _langid(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    sp = S.three_way_split(d, F.col("doc_id"), seed=42)
    langs = LI.languages(sp.where(F.col("split") == "train"))
    sp = sp.withColumn("train_lang", F.when(F.col("split") == "train", F.col("lang")))
    pred = LI.fit_and_score(sp, langs)
    return sp.select("doc_id", "split", "lang").join(pred, "doc_id", "left")


_LANGID_SQL = "WITH " + _SPLIT_SQL + """,
grams AS (SELECT doc_id, lang, split, substr(lt, i, 3) AS gram FROM (
            SELECT doc_id, lang, split, lower(text) AS lt, unnest(range(1, length(lower(text)) - 1)) AS i FROM split)),
tr AS (SELECT gram, lang FROM grams WHERE split = 'train'),
prof AS (SELECT gram, lang, count(*) AS c FROM tr GROUP BY gram, lang),
tot AS (SELECT lang, count(*) AS t FROM tr GROUP BY lang),
v AS (SELECT count(DISTINCT gram) AS v FROM tr),
dg AS (SELECT doc_id, gram, count(*) AS n FROM grams GROUP BY doc_id, gram),
dv AS (SELECT doc_id, sum(n) AS nv FROM dg WHERE gram IN (SELECT gram FROM prof) GROUP BY doc_id),
hit AS (SELECT dg.doc_id, p.lang, sum(dg.n * ln(p.c + 1)) AS h FROM dg JOIN prof p ON dg.gram = p.gram
        GROUP BY dg.doc_id, p.lang),
sc AS (SELECT dv.doc_id, tot.lang, coalesce(hit.h, 0) - dv.nv * ln(tot.t + v.v) AS s
       FROM dv JOIN tot ON TRUE JOIN v ON TRUE LEFT JOIN hit ON hit.doc_id = dv.doc_id AND hit.lang = tot.lang),
best AS (SELECT doc_id, lang AS predicted FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM sc) WHERE r = 1),
pred AS (SELECT s.doc_id, s.split, s.lang, b.predicted FROM split s LEFT JOIN best b ON s.doc_id = b.doc_id)"""


@query("language_id", _LANGID_SQL + "\nSELECT doc_id, split, lang, predicted FROM pred")
def q_language_id(spark, sf):
    """Trigram language model fitted on the training split, every
    document scored."""
    return _langid(spark, sf)


@query("language_id_accuracy", _LANGID_SQL + """
SELECT split, count(*) AS n, round(avg(CASE WHEN predicted = lang THEN 1.0 ELSE 0.0 END), 5) AS accuracy
FROM pred GROUP BY split""")
def q_language_id_accuracy(spark, sf):
    """A21 on the language model: accuracy per split."""
    p = _langid(spark, sf)
    return p.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(F.col("predicted") == F.col("lang"), 1.0).otherwise(0.0)), 5).alias("accuracy"))





@query("index_with_langid", _LANGID_SQL + """,
m AS (SELECT CAST(doc_id AS VARCHAR) AS msd_id, source AS msd_artist, 'doc ' || CAST(doc_id AS VARCHAR) AS msd_title,
             regexp_replace(replace(source, ' ', '_') || '___' || replace('doc ' || CAST(doc_id AS VARCHAR), ' ', '_'),
                            '[^\\p{L}\\p{N}_]', '', 'g') AS fn,
             coalesce(length(text) > 0, false) AS found,
             CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS n_words,
             doc_id FROM documents),
j AS (SELECT m.*, p.predicted AS lang, NOT (m.found AND p.predicted IS NULL) AS upd
      FROM m LEFT JOIN pred p ON m.doc_id = p.doc_id)
SELECT msd_id, msd_artist, msd_title,
  CAST(CASE WHEN upd THEN (CASE WHEN found AND lang = 'en' THEN 1 ELSE 0 END) ELSE -1 END AS INTEGER) AS is_english,
  CAST(CASE WHEN upd THEN (CASE WHEN found THEN 1 ELSE 0 END) ELSE -1 END AS INTEGER) AS lyrics_available,
  CAST(CASE WHEN upd THEN (CASE WHEN found THEN n_words ELSE 0 END) ELSE -1 END AS INTEGER) AS wordcount,
  CASE WHEN upd THEN fn ELSE '-1' END AS lyrics_filename
FROM j""")
def q_index_with_langid(spark, sf):
    """F4 + M9 + L1: the index with the language flag from the trigram model
    (a document the model cannot score stays unprocessed, like a detector
    error)."""
    from cadenza.plans.index import index_songs
    from cadenza.sources.songs import song_mapping

    pred = _langid(spark, sf).select("doc_id", F.col("predicted").alias("lang"))
    d = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    corpus = d.join(pred, "doc_id", "left").select(
        TX.safe_file_name(F.col("source"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
        .alias("lyrics_filename"), F.col("text").alias("lyrics"), "lang")
    return index_songs(song_mapping(spark, sf), corpus)
