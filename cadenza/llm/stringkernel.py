"""Language identification with a blended-spectrum string kernel.

Two texts' kernel is the number of character n-grams (n = 1 to 3) present in
both, divided by the root of the product of how many each holds. A Nyström map
over landmark texts turns kernel ridge regression, one label against the rest,
into a small linear system; a batch of texts is scored by one matrix product.

Fitting takes a bounded sample of labelled rows (``sample_rows``); every row is
scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import slices, worker_cache

#: Bounds of the fit: labelled documents in all, but ``LEAST_ROWS`` of each label at any rate; landmarks in all.
SAMPLE_ROWS, LEAST_ROWS, LANDMARKS = 1600, 4, 192
RIDGE = 1e-3
UNDETERMINED = "und"
#: Share of the sample's median margin (best ridge output less the second) under which a text's language is rejected.
MIN_SHARE = 0.1
#: Median margin under which the labels can't be told apart at all, so that nothing is rejected.
FLAT = 1e-3
#: Factor from ridge outputs (targets -1 and 1) to the soft-max whose largest term is the score.
SHARPNESS = 2.0

def _codes(text: str) -> np.ndarray:
    """Lower-cased code points with one space for each run of anything but letters, and one at either end."""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = cache["letters"][c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, 32)[keep]
    return np.concatenate([[32], c, [32] if len(c) and c[-1] != 32 else []]).astype(np.int64)


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct n-grams (n = 1 to 3), each packed 21 bits a character; empty for null or no letter."""
    c = _codes(text or "")
    if len(c) < 3:
        return np.empty(0, np.int64)
    u3 = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
    u2 = np.unique(np.append(u3 >> 21, (c[-2] << 21) | c[-1]))
    u1 = np.unique(np.append(u2 >> 21, c[-1]))
    return np.concatenate([u1, u2, u3])


def _presence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(vocabulary)), np.float32)
    for row, s in zip(out, sets):
        if len(s) and len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, s), len(vocabulary) - 1)
            row[at[vocabulary[at] == s]] = 1
    return out


@dataclass
class KernelModel:
    labels: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks, sorted
    # The landmarks' presence rows (vocabulary x landmarks) and the ridge coefficients (landmarks x labels), as their
    # product where the labels are no more than the landmarks, else as the two factors: the outputs are the same.
    weights: list[np.ndarray]
    typical: float = 1.0  # median margin of the rows fitted on: it falls with the labels' number, and so do all margins

    def outputs(self, sets: list[np.ndarray]) -> np.ndarray:
        """Ridge outputs, texts x labels, by one matrix product."""
        norm = np.sqrt(np.maximum(1, [len(s) for s in sets]))[:, None]
        out = _presence(sets, self.vocabulary)
        for w in self.weights:
            out = out @ w
        return out / norm

    def predict(self, texts: list[str | None], batch: int = 128) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, soft-max score and margin as a share of the typical one, for each text."""
        names: list[str] = []
        scores: list[np.ndarray] = []
        shares: list[np.ndarray] = []
        for at in range(0, len(texts), batch):
            sets = [grams(t) for t in texts[at: at + batch]]
            if not self.labels:
                names += [UNDETERMINED] * len(sets)
                scores.append(np.zeros(len(sets)))
                shares.append(np.zeros(len(sets)))
                continue
            out = self.outputs(sets).astype(np.float64)
            f = SHARPNESS * out
            e = np.exp(f - f.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            some = np.array([len(s) > 0 for s in sets])
            names += [self.labels[i] if ok else UNDETERMINED for i, ok in zip(p.argmax(axis=1), some)]
            scores.append(np.where(some, p.max(axis=1), 0.0))
            shares.append(np.where(some, margins(out) / self.typical if self.typical > FLAT else 1.0, 0.0))
        return names, *(np.concatenate(x) if x else np.empty(0) for x in (scores, shares))


def margins(out: np.ndarray) -> np.ndarray:
    """Best output less the second, per row; with one label the output itself."""
    if out.shape[1] == 1:
        return out[:, 0]
    two = np.partition(out, -2, axis=1)
    return two[:, -1] - two[:, -2]


def fit_sets(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Nyström kernel ridge regression, one label against the rest, on the n-gram sets of labelled texts."""
    names = sorted(set(labels))
    if not names:
        return KernelModel([], np.empty(0, np.int64), [np.empty((0, 0), np.float32)])
    per = max(1, landmarks // len(names))
    seen: dict[str, int] = {}
    chosen = []
    for i, name in enumerate(labels):
        if seen.setdefault(name, 0) < per and len(chosen) < landmarks:
            seen[name] += 1
            chosen.append(i)
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    size = np.sqrt(np.maximum(1, [len(s) for s in sets])).astype(np.float64)
    rows = _presence([sets[i] for i in chosen], vocabulary) / size[chosen][:, None].astype(np.float32)
    k_nm = np.vstack([_presence(sets[a: a + 256], vocabulary) @ rows.T for a in range(0, len(sets), 256)]) / size[:, None]
    k_mm = k_nm[chosen]
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    left = k_nm.T @ k_nm + ridge * len(sets) * k_mm + 1e-8 * np.eye(len(chosen))
    alpha = np.linalg.lstsq(left, k_nm.T @ y, rcond=None)[0]
    factors = [rows.T @ alpha] if len(names) <= len(chosen) else [rows.T, alpha]
    return KernelModel(names, vocabulary, [w.astype(np.float32) for w in factors], float(np.median(margins(k_nm @ alpha))))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, least_rows: int = LEAST_ROWS, landmarks: int = LANDMARKS) -> KernelModel:
    """Fit on ``sample_rows`` labelled rows, as many for each label, but on ``least_rows`` of a label at any rate.

    The rows are those with the smallest hash of their id, found from the ids alone; only their distinct n-grams,
    never their texts, come to the driver. Every label is learned, however many there are; landmarks are the first rows of
    as many labels as ``landmarks`` allows. Null labels, null ids and texts without a letter teach nothing.
    """
    ids = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label")
                          ).where("id IS NOT NULL AND label IS NOT NULL")
    n_labels = ids.select("label").distinct().count()
    if not n_labels:
        return fit_sets([], [], landmarks)
    per = max(1, least_rows, sample_rows // n_labels)
    # In hash order: parts by the hash's first 12 bits are counted, and only those that hold the first `per` are ranked.
    ids = ids.distinct().withColumn("part", F.shiftrightunsigned(F.xxhash64("id"), 52))
    before = "coalesce(sum(n) OVER (PARTITION BY label ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    parts = ids.groupBy("label", "part").agg(F.count("*").alias("n")).selectExpr("label", "part", f"{before} AS before")
    picked = (ids.join(parts.where(f"before < {per}").select("label", "part"), ["label", "part"]).selectExpr(
        "id", "label", "row_number() OVER (PARTITION BY label ORDER BY part, xxhash64(id), id) AS n").where(f"n <= {per}"))
    chosen = {(r["id"], r["label"]) for r in picked.select("id", "label").collect()}
    wanted = labelled.sparkSession.createDataFrame([(i,) for i in {i for i, _ in chosen}], "id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([grams(t) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))],
                names=["id", "label", "grams"])

    rows = (labelled.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                            F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(wanted), "id", "left_semi").mapInArrow(run, "id long, label string, grams array<long>")
            .dropDuplicates(["id", "label"]).toArrow())
    found = sorted((_mixed(i), i, label, np.array(g, np.int64)) for i, label, g in zip(
        rows["id"].to_pylist(), rows["label"].to_pylist(), rows["grams"].to_numpy()) if (i, label) in chosen and len(g))
    return fit_sets([g for *_, g in found], [label for _, _, label, _ in found], landmarks)


def _mixed(i: int) -> int:
    """An order of the sample that does not follow the ids."""
    return (i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) >> 11


def predict(model: KernelModel, spark) -> Column:
    """A function of a text column that gives struct<lang_pred, score, share>.

    ``lang_pred`` is a learned label, or ``und`` (score 0) for null or a text without a letter; ties go to the
    label that sorts first. The model that each task gets is bounded by the sample's parameters.
    """
    shared = spark.sparkContext.broadcast((model.labels, model.vocabulary, model.weights, model.typical))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("share", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double, share: double>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = KernelModel(*shared.value)
        for column in texts:
            parts = [pa.array([], kind)]
            for b in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text"):
                names, scores, shares = model.predict(b.column(0).to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                                         pa.array(shares, pa.float64())], fields=list(kind)))
            yield pa.concat_arrays(parts)

    return score


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2 (false for null)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``, learned from the rows that are not held out.

    * null text, no letter: ``und``, score 0; very long texts are read whole;
    * no usable label in the table: ``und`` for all; one label only: that label for every text with a letter;
    * equal texts, repeated rows: the same answer, one result row each; null doc_id: not held out, not learned from;
    * empty table: empty result; extra columns are not read.
    """
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, label_col)
    score = predict(model, docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                        score(F.col(text_col).cast("string")).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


def keep_identified(docs: DataFrame, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose best label leads the second by ``min_share`` of the typical margin or more.

    Learned as in ``identify``. The typical margin is the median over the sample, so the rejection does not depend on
    the number of labels. Null texts and texts without a letter go; short clean texts stay. With one label a text goes
    that shares next to no n-grams with its sample, such as one in another script. Without a label in the table, or if
    its labels can't be told apart, nothing can be rejected but null texts and texts without a letter.
    """
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, label_col)
    if not model.labels:
        return docs.where(F.col(text_col).rlike("\\p{L}"))
    p = predict(model, docs.sparkSession)(F.col(text_col).cast("string"))
    found = docs.withColumn("__p", p).where((F.col("__p.lang_pred") != UNDETERMINED) & (F.col("__p.share") >= min_share))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
