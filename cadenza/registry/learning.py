"""Metric queries (A18-A23, A25, F13, F14) and model queries (M3-M7, M10;
the MLlib ones are rows-only: their fits have no SQL oracle)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadenza.functions import text as TX
from cadenza.operators import embeddings as EM
from cadenza.operators import langid as LI
from cadenza.operators import metrics as ME
from cadenza.operators import models as MO
from cadenza.operators import projection as PR
from cadenza.operators import sampling as S
from cadenza.operators import svm as SV
from cadenza.operators import textcnn as CN
from cadenza.operators import vectors as VE
from cadenza.operators import vocab as V
from cadenza.registry.base import query
from cadenza.registry.songs import _SPLIT_SQL
from cadenza.registry.sqlparts import preprocess_sql, word_count_sql
from cadenza.registry.text import VOCAB_SIZE
from cadenza.registry.vectors import _LANGID_SQL, _TFIDF_SQL, _langid, split_blocks
from cadenza.session import scratch_path
from cadenza.sources.sinks import materialise
from cadenza.sources.tables import read_table

_PAIRS_SQL = """pairs AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label,
                        CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS prediction FROM labels)"""


def _pairs(spark, sf):
    """A two-class prediction table: label from quality, prediction from toxicity."""
    l = read_table(spark, sf, "labels")
    return l.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"),
                    F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("prediction"))


_CM_SQL = "WITH " + _PAIRS_SQL + """,
cls AS (SELECT DISTINCT label AS c FROM pairs UNION SELECT DISTINCT prediction FROM pairs),
counts AS (SELECT label, prediction, count(*) AS n FROM pairs GROUP BY label, prediction),
cm AS (SELECT a.c AS label, b.c AS prediction, CAST(coalesce(counts.n, 0) AS BIGINT) AS n
       FROM cls a JOIN cls b ON TRUE LEFT JOIN counts ON counts.label = a.c AND counts.prediction = b.c),
m AS (SELECT label, sum(n) AS row_sum, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM cm GROUP BY label),
c AS (SELECT prediction AS label, sum(n) AS col_sum FROM cm GROUP BY prediction),
mg AS (SELECT m.label, m.tp, m.row_sum, c.col_sum, sum(m.tp) OVER () AS diag, sum(m.row_sum) OVER () AS total
       FROM m JOIN c ON m.label = c.label)"""


@query("confusion_long", _CM_SQL + "\nSELECT label, prediction, n FROM cm")
def q_confusion_long(spark, sf):
    """Long confusion matrix with zero cells."""
    return ME.confusion_long(_pairs(spark, sf))


@query("confusion_wide", _CM_SQL + """
SELECT label, CAST(sum(CASE WHEN prediction = 'bad' THEN n ELSE 0 END) AS BIGINT) AS bad,
       CAST(sum(CASE WHEN prediction = 'good' THEN n ELSE 0 END) AS BIGINT) AS good FROM cm GROUP BY label""")
def q_confusion_wide(spark, sf):
    """A18 wide: rows = true class, one column per predicted class."""
    return ME.confusion_wide(ME.confusion_long(_pairs(spark, sf)), ["bad", "good"])


@query("per_class_report", _CM_SQL + """
SELECT label AS cls, CAST(row_sum AS BIGINT) AS total, CAST(tp AS BIGINT) AS correct,
       round(tp / row_sum * 100, 5) AS pct, CAST(col_sum - tp AS BIGINT) AS incorrect FROM mg
UNION ALL SELECT 'TOTAL', CAST(sum(row_sum) AS BIGINT), CAST(sum(tp) AS BIGINT), round(sum(tp) / sum(row_sum) * 100, 5),
       CAST(sum(col_sum - tp) AS BIGINT) FROM mg""")
def q_per_class_report(spark, sf):
    """Per-class totals, correct, pct, incorrect, and the overall row."""
    return ME.per_class_report(ME.confusion_long(_pairs(spark, sf)))


def _scores_sql(diag_tn: bool) -> str:
    tn = "(diag - tp)" if diag_tn else "(total - tp - (col_sum - tp) - (row_sum - tp))"
    return _CM_SQL + f"""
SELECT label AS cls, round(tp / col_sum, 5) AS precision, round(tp / row_sum, 5) AS recall,
       round((tp + {tn}) / (tp + {tn} + (col_sum - tp) + (row_sum - tp)), 5) AS accuracy,
       round(2 * ((tp / col_sum) * (tp / row_sum)) / ((tp / col_sum) + (tp / row_sum)), 5) AS f1 FROM mg"""


@query("per_class_f1", _scores_sql(True))
def q_per_class_f1(spark, sf):
    """A20 as published (TN = other diagonal cells)."""
    return ME.per_class_scores(ME.confusion_long(_pairs(spark, sf)), diagonal_tn=True)


@query("per_class_scores", _scores_sql(False))
def q_per_class_scores(spark, sf):
    """A20 with the usual TN = total - tp - fp - fn."""
    return ME.per_class_scores(ME.confusion_long(_pairs(spark, sf)), diagonal_tn=False)


@query("accuracy", "WITH " + _PAIRS_SQL + """
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 5) AS accuracy FROM pairs""")
def q_accuracy(spark, sf):
    """mean(prediction == label)."""
    p = _pairs(spark, sf)
    return p.agg(F.round(ME.accuracy(p), 5).alias("accuracy"))


@query("langid_confusion", _LANGID_SQL + """,
ev AS (SELECT lang AS label, predicted AS prediction FROM pred WHERE split <> 'train'),
cls AS (SELECT DISTINCT label AS c FROM ev UNION SELECT DISTINCT prediction FROM ev WHERE prediction IS NOT NULL),
counts AS (SELECT label, prediction, count(*) AS n FROM ev GROUP BY label, prediction)
SELECT a.c AS label, b.c AS prediction, CAST(coalesce(counts.n, 0) AS BIGINT) AS n
FROM cls a JOIN cls b ON TRUE LEFT JOIN counts ON counts.label = a.c AND counts.prediction = b.c""")
def q_langid_confusion(spark, sf):
    """A18 over the language model's dev + test predictions."""
    p = _langid(spark, sf).where(F.col("split") != "train")
    return ME.confusion_long(p, "lang", "predicted")


_GAPS_SQL = """pairs AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unsure' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label,
                        CASE WHEN doc_id % 11 = 0 THEN 'junk' WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS prediction FROM labels)"""
_GAP_CM_SQL = _CM_SQL.replace(_PAIRS_SQL, _GAPS_SQL)


def _gap_pairs(spark, sf):
    """'unsure' is a label that is never predicted, 'junk' a prediction that is never true."""
    l = read_table(spark, sf, "labels")
    return l.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "unsure").when(F.col("quality") == 1, "good")
                    .otherwise("bad").alias("label"),
                    F.when(F.col("doc_id") % 11 == 0, "junk").when(F.col("toxic") == 1, "bad").otherwise("good")
                    .alias("prediction"))


_F1_SQL = """CASE WHEN col_sum = 0 OR row_sum = 0 THEN NULL WHEN tp = 0 THEN 0.0
     ELSE round(2 * ((tp / col_sum) * (tp / row_sum)) / ((tp / col_sum) + (tp / row_sum)), 5) END"""


@query("per_class_scores_gaps", "WITH " + _GAP_CM_SQL.split("WITH ", 1)[1] + f"""
SELECT label AS cls, round(tp / nullif(col_sum, 0), 5) AS precision, round(tp / nullif(row_sum, 0), 5) AS recall,
       round((tp + (diag - tp)) / (tp + (diag - tp) + (col_sum - tp) + (row_sum - tp)), 5) AS accuracy, {_F1_SQL} AS f1 FROM mg""")
def q_per_class_scores_gaps(spark, sf):
    """A20 where a class is never predicted and another never true: NULL, not an error."""
    return ME.per_class_scores(ME.confusion_long(_gap_pairs(spark, sf)))


@query("per_class_report_gaps", "WITH " + _GAP_CM_SQL.split("WITH ", 1)[1] + """
SELECT label AS cls, CAST(row_sum AS BIGINT) AS total, CAST(tp AS BIGINT) AS correct,
       round(tp / nullif(row_sum, 0) * 100, 5) AS pct, CAST(col_sum - tp AS BIGINT) AS incorrect FROM mg
UNION ALL SELECT 'TOTAL', CAST(sum(row_sum) AS BIGINT), CAST(sum(tp) AS BIGINT), round(sum(tp) / sum(row_sum) * 100, 5),
       CAST(sum(col_sum - tp) AS BIGINT) FROM mg""")
def q_per_class_report_gaps(spark, sf):
    """A19 with a class that has no true rows."""
    return ME.per_class_report(ME.confusion_long(_gap_pairs(spark, sf)))


@query("f1_by_run", _CM_SQL + """,
a AS (SELECT label AS cls, """ + _F1_SQL + """ AS f1 FROM mg),
""" + _GAP_CM_SQL.split("WITH ", 1)[1].replace("pairs", "gpairs").replace("cls AS", "gcls AS").replace("FROM cls", "FROM gcls")
       .replace("JOIN cls", "JOIN gcls").replace("counts", "gcounts").replace("cm AS", "gcm AS").replace("FROM cm", "FROM gcm")
       .replace("m AS (SELECT label, sum", "gm AS (SELECT label, sum").replace("c AS (SELECT prediction", "gc AS (SELECT prediction")
       .replace("mg AS", "gmg AS").replace("FROM m JOIN c ON m.label = c.label", "FROM gm m JOIN gc c ON m.label = c.label") + """,
b AS (SELECT label AS cls, """ + _F1_SQL + """ AS f1 FROM gmg)
SELECT coalesce(a.cls, b.cls) AS cls, coalesce(a.f1, -1) AS two_classes, coalesce(b.f1, -1) AS with_gaps
FROM a FULL JOIN b ON a.cls = b.cls""")
def q_f1_by_run(spark, sf):
    """F1 per class for two runs side by side, -1 where a run lacks the
    class (two classes only) or never predicts it."""
    a = ME.confusion_long(_pairs(spark, sf)).withColumn("run", F.lit("two_classes"))
    b = ME.confusion_long(_gap_pairs(spark, sf)).withColumn("run", F.lit("with_gaps"))
    return ME.f1_by_run(a.unionByName(b), ["two_classes", "with_gaps"])


@query("loss_windows", """
SELECT event_type AS dataset, CAST(floor(event_id / 2000) AS BIGINT) AS window, count(*) AS n,
       round(avg(value), 5) AS mean_loss FROM events GROUP BY event_type, floor(event_id / 2000)""")
def q_loss_windows(spark, sf):
    """Mean loss per 2000-step window and dataset (events as a step log)."""
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("dataset"),
                                               F.col("event_id").alias("step"), F.col("value"))
    return ME.windowed_mean(e, "step", "value", 2000, ["dataset"])


@query("one_hot", """
WITH c AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT lang FROM documents)),
k AS (SELECT count(*) AS k FROM c)
SELECT d.doc_id, c.code,
       array_to_string(list_transform(range(0, k.k), lambda i: CASE WHEN i = c.code THEN '1' ELSE '0' END), ',') AS one_hot,
       c.code AS decoded
FROM documents d JOIN c ON d.lang = c.lang, k""")
def q_one_hot(spark, sf):
    """F13 + F14: class code -> one-hot vector -> arg-max back to the code."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    coded = S.class_codes(d, "lang", "code")
    k = d.select("lang").distinct().agg(F.count(F.lit(1)).alias("k"))
    coded = coded.join(F.broadcast(k), on=F.lit(True), how="left_outer")
    oh = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: (i == F.col("code")).cast("int"))
    return coded.select("doc_id", "code", F.array_join(oh.cast("array<string>"), ",").alias("one_hot"),
                        VE.arg_max(oh).alias("decoded"))


# ------------------------------------------------------------ models

_NB_SQL = _TFIDF_SQL + """,
x AS (SELECT f.*, s.lang AS label, s.split FROM f JOIN split s ON f.doc_id = s.doc_id),
cs AS (SELECT label AS class, term, sum(tfidf) AS s FROM x WHERE split = 'train' GROUP BY 1, 2),
vv AS (SELECT count(DISTINCT term) AS v FROM x WHERE split = 'train'),
tot AS (SELECT class, sum(s) AS total FROM cs GROUP BY 1),
pr AS (SELECT lang AS class, ln(count(*) / (SELECT count(*) FROM split WHERE split = 'train')) AS prior
       FROM split WHERE split = 'train' GROUP BY 1),
hh AS (SELECT x.doc_id, cs.class, sum(x.tfidf * ln((cs.s + 1) / 1)) AS h FROM x JOIN cs ON x.term = cs.term GROUP BY 1, 2),
ww AS (SELECT doc_id, sum(tfidf) AS w FROM x GROUP BY 1),
sc AS (SELECT s.doc_id, s.split, s.lang AS label, pr.class,
              pr.prior + coalesce(hh.h, 0) - coalesce(ww.w, 0) * ln(coalesce(tot.total, 0) + vv.v) AS score
       FROM split s JOIN pr ON TRUE JOIN vv ON TRUE LEFT JOIN tot ON tot.class = pr.class
       LEFT JOIN ww ON ww.doc_id = s.doc_id LEFT JOIN hh ON hh.doc_id = s.doc_id AND hh.class = pr.class)"""


def _naive_bayes(spark, sf):
    """(split documents, long class scores) of the naive Bayes model fitted on train."""
    docs, features = split_blocks(spark, sf)
    scores = MO.naive_bayes(features, docs.where("split = 'train'"), docs)
    features.release()
    return docs, scores


@query("nb_predict", _NB_SQL + """
SELECT doc_id, split, label, class AS predicted FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS r FROM sc) WHERE r = 1""")
def q_nb_predict(spark, sf):
    """M3 + M7: multinomial naive Bayes on TF-IDF, fitted on train, every split scored."""
    docs, scores = _naive_bayes(spark, sf)
    return docs.join(MO.best_class(scores), "doc_id", "left").select("doc_id", "split", "label", "predicted")


@query("cross_entropy", _NB_SQL + """,
z AS (SELECT doc_id, ln(sum(exp(score - m))) + any_value(m) AS z FROM (
        SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM sc) GROUP BY doc_id)
SELECT split, round(avg(z.z - score), 5) AS cross_entropy FROM sc JOIN z ON sc.doc_id = z.doc_id
WHERE class = label GROUP BY split""")
def q_cross_entropy(spark, sf):
    """Mean -ln p(true class) of the naive Bayes model per split."""
    docs, scores = _naive_bayes(spark, sf)
    loss = MO.log_loss(materialise(scores, "scores"), docs)
    return docs.join(loss, "doc_id").groupBy("split").agg(F.round(F.avg("loss"), 5).alias("cross_entropy"))


def _doc_splits(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return S.three_way_split(d, F.col("doc_id"), seed=42)


@query("svm_predict", _TFIDF_SQL + """,
svm_docs AS (SELECT doc_id, lang AS label FROM split WHERE split = 'train'),
""" + SV.fit_sql("f", "svm_docs") + """,
svm_s AS (SELECT s.doc_id, b.class, coalesce(h.h, 0) + b.w AS m FROM split s JOIN svm b ON b.term IS NULL
          LEFT JOIN (SELECT f.doc_id, w.class, sum(f.tfidf * w.w) AS h FROM f JOIN svm w ON f.term = w.term GROUP BY 1, 2) h
          ON h.doc_id = s.doc_id AND h.class = b.class),
svm_b AS (SELECT doc_id, class FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, class) AS r FROM svm_s) WHERE r = 1)
SELECT s.doc_id, s.split, s.lang AS label, b.class AS predicted FROM split s LEFT JOIN svm_b b ON s.doc_id = b.doc_id""")
def q_svm_predict(spark, sf):
    """M4 + M7: one-vs-rest linear SVM on M2's features, five passes on train, every split scored."""
    docs, features = split_blocks(spark, sf, SV.batch_of("doc_id", SV.PARTS, 42), SV.PARTS)
    weights = SV.fit(features, docs.where("split = 'train'"))
    predicted = SV.predict(features, docs, weights).select("doc_id", "split", "label", "predicted")
    features.release()
    return predicted


def _w2v(spark, sf, dim=32):
    """(stored tokens, word vectors): skip-gram over the W3 vocabulary, other words as UNK."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    toks = materialise(d.select("doc_id", TX.preprocess(F.col("text"), "treebank").alias("tokens")), "tokens")
    vocab = materialise(V.vocabulary(V.batch_counts(toks, F.col("tokens")), 10_000), "vocabulary")
    pairs = EM.id_pairs(V.encode_docs(toks, F.col("tokens"), vocab), F.col("ids"), window=4)
    return toks, EM.fit(pairs, vocab, dim=dim, passes=2)


@query("word2vec_vectors")
def q_word2vec_vectors(spark, sf):
    """M5: skip-gram word vectors (normalised) of the vocabulary and UNK."""
    _, vecs = _w2v(spark, sf)
    return vecs.select("word", F.array_join(F.transform("vec", lambda x: F.format_number(x, 5)), ",")
                       .alias("vec_text"))


@query("pooled_mlp_predict")
def q_pooled_mlp_predict(spark, sf):
    """M6 re-aimed: window means of 3, 4 and 5 word vectors, the largest per
    dimension -> multilayer perceptron. Every document is scored."""
    dim, sizes = 16, (3, 4, 5)
    toks, vecs = _w2v(spark, sf, dim)
    lab = _doc_splits(spark, sf).select("doc_id", "split", "label")
    # stored before the iterative fit: every optimiser pass would otherwise redo the windows
    data = materialise(MO.window_features(toks, "tokens", vecs, dim, sizes).join(lab, "doc_id"), "windows")
    train = data.where("split = 'train' AND label IS NOT NULL")
    model = MO.fit_mlp(train, dim * len(sizes), len(LI.languages(train, "label")))
    labels = model.stages[0].labelsArray[0]
    names = F.array(*[F.lit(x) for x in labels])
    return model.transform(data).select("doc_id", "split", "label", F.try_element_at(
        names, F.col("prediction").cast("int") + 1).alias("predicted"))


@query("cnn_predict")
def q_cnn_predict(spark, sf):
    """M6: convolution filters of 3, 4 and 5 words, largest response, drop-out and soft-max, trained on the training
    split over M5's vectors. Every document is scored."""
    from cadenza.plans.dataset import build_dataset
    from cadenza.sources.songs import labelled_documents

    ds = materialise(build_dataset(labelled_documents(spark, sf), balance=False, key="doc_id", materialize=False).select(
        "doc_id", "split", F.col("mood").alias("label"), "tokens", "tokens_padded"), "dataset", spread="doc_id")
    train = ds.where("split = 'train'")
    vocab = materialise(V.vocabulary(V.batch_counts(train, F.col("tokens")), VOCAB_SIZE), "vocabulary")
    vectors = EM.fit(EM.id_pairs(V.encode_docs(train, F.col("tokens"), vocab), F.col("ids"), window=4), vocab, dim=16, passes=2)
    ids = materialise(V.encode_docs(ds, F.col("tokens_padded"), vocab).join(ds.select("doc_id", "split", "label"), "doc_id"), "ids")
    known = ids.where("split = 'train' AND label IS NOT NULL")
    net, _ = CN.fit(known, CN.word_matrix(vocab, vectors, 16), LI.languages(known, "label"), filters=16, passes=3)
    return ids.join(CN.predict(net, ids), "doc_id").select("doc_id", "split", "label", "predicted")


@query("embedding_neighbours")
def q_embedding_neighbours(spark, sf):
    """2-D neighbour embedding of the first 500 vectors."""
    return PR.neighbour_embedding(read_table(spark, sf, "embeddings"), "vec_id", "embedding", limit=500)


@query("embedding_pca")
def q_embedding_pca(spark, sf):
    """M10 re-aimed: 2-D PCA projection of the embedding table."""
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    return MO.project_2d(e, "vec_id", "embedding")


_TRAIN_VOCAB_SQL = _SPLIT_SQL + f""",
cut AS (SELECT CAST(floor(quantile_cont({word_count_sql('text')}, 0.75)) AS INTEGER) AS cutoff FROM documents WHERE length(text) > 0),
toks AS (SELECT doc_id, {preprocess_sql('text')} AS t FROM documents),
padded AS (SELECT doc_id, CASE WHEN len(t) >= cutoff THEN t[1:cutoff]
                 ELSE list_concat(t, list_transform(range(cutoff - len(t)), lambda x: '<PAD>')) END AS t FROM toks, cut),
stream AS (SELECT t.doc_id, CAST(generate_subscripts(t.t, 1) - 1 AS INTEGER) AS pos, unnest(t.t) AS word
           FROM toks t JOIN split s ON t.doc_id = s.doc_id WHERE s.split = 'train'),
counts AS (SELECT word, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS first FROM stream GROUP BY word),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS word_id, word
           FROM counts ORDER BY n DESC, first LIMIT {VOCAB_SIZE - 1}),
vmap AS (SELECT map(list(word), list(word_id)) AS ids FROM ranked),
codes AS (SELECT lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))"""


_RUN_SQL = """
WITH base AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, text FROM documents WHERE length(text) > 0),
sp AS (SELECT *, CASE WHEN rk < floor(n_all * 0.8) THEN 'train' WHEN rk < floor(n_all * 0.9) THEN 'dev' ELSE 'test' END AS split
       FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS rk, count(*) OVER () AS n_all FROM base)),
c AS (SELECT lang, count(*) AS n FROM sp WHERE split = 'train' GROUP BY lang),
p AS (SELECT lang, (max(n) OVER () - n) // n AS copies, (max(n) OVER () - n) % n AS rest FROM c),
j AS (SELECT sp.*, copies, rest, row_number() OVER (PARTITION BY sp.lang ORDER BY md5('42|pad|' || id), id) - 1 AS r
      FROM sp JOIN p ON sp.lang = p.lang WHERE split = 'train'),
one AS (SELECT doc_id, split, lang, text FROM (
  SELECT id || '|' || CAST(unnest(range(0, copies + 1 + CASE WHEN r < rest THEN 1 ELSE 0 END)) AS VARCHAR) AS doc_id, split, lang, text FROM j
  UNION ALL SELECT id || '|0', split, lang, text FROM sp WHERE split <> 'train')),
split AS (SELECT doc_id, split, lang FROM one),
terms AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM one) GROUP BY doc_id, term)""" + (
    _TFIDF_SQL[_TFIDF_SQL.index(",\ntr AS"):] + _NB_SQL[len(_TFIDF_SQL):]) + """,
best AS (SELECT doc_id, class FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS r FROM sc) WHERE r = 1)
SELECT s.split, count(*) AS n, round(avg(CASE WHEN s.lang = b.class THEN 1.0 ELSE 0.0 END), 5) AS accuracy, count(*) AS n_vectorised,
       'Em-300_FS-3-4-5_NF-128_D-0.5_L2-0.01_B-128_Ep-8_W2V-0_V-2000_nb' AS run_key
FROM split s JOIN best b ON s.doc_id = b.doc_id GROUP BY s.split"""


@query("classification_run", _RUN_SQL)
def q_classification_run(spark, sf):
    """Staged run (dataset -> balanced training split -> vocabulary -> vectorised splits -> naive
    Bayes -> per-split accuracy). A second call with the same
    options re-reads every stage."""
    from cadenza.plans.classify import RunOptions, run_classification
    from cadenza.sources.songs import labelled_documents

    root = scratch_path(spark, "runs", uuid.uuid4().hex)
    opts = RunOptions(vocab_size=2000, model="nb")
    lab = labelled_documents(spark, sf)
    inputs = [f"{sf}/documents.parquet"]
    run_classification(spark, lab, opts, sf, root=root, inputs=inputs)
    return run_classification(spark, lab, opts, sf, root=root, inputs=inputs)


@query("vectorised_xy", "WITH " + _TRAIN_VOCAB_SQL + """
SELECT s.doc_id, s.split, coalesce(array_to_string(list_transform(p.t, lambda w: coalesce(v.ids[w], 0)), ' '), '') AS x, c.code AS y
FROM split s JOIN padded p ON s.doc_id = p.doc_id JOIN codes c ON s.lang = c.lang, vmap v""")
def q_vectorised_xy(spark, sf):
    """Padded id arrays and class codes of the training, dev and test rows."""
    from cadenza.plans.classify import split_xy
    from cadenza.plans.dataset import build_dataset
    from cadenza.sources.songs import labelled_documents

    ds = materialise(build_dataset(labelled_documents(spark, sf), balance=False, key="doc_id", materialize=False).select(
        "doc_id", "split", "mood_cats", "tokens", "tokens_padded"), "dataset")
    vocab = V.vocabulary(V.batch_counts(ds.where("split = 'train'"), F.col("tokens")), VOCAB_SIZE)
    vec = ds.select("doc_id", "split", "mood_cats").join(V.encode_docs(ds, F.col("tokens_padded"), vocab), "doc_id")
    return split_xy(vec).select("doc_id", "split", F.array_join(F.col("x").cast("array<string>"), " ").alias("x"), "y")
