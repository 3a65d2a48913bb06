"""Personal data and information-theoretic sanitisation.

Patterns find the protected entities (mail and network addresses, card and
phone numbers). What else gives an entity away is learned from the corpus: for a
term t that stands near an entity e, the pointwise mutual information
ln(N n(e,t) / (n(e) n(t))) over document counts, as a share of the entity's
information content ln(N / n(e)), is what the counts say: 1 if t occurs with e only, 0 if
independently. The term's disclosure is that times n / (n + 1/2), with n the number of different texts that
show the pair: one text is weak evidence for so rare a term, and copies of a text are none.
Near the entity, terms over one threshold are generalised, over a higher one removed.

The scan keeps each document's spans and contexts (no text); pair counts come from
those. Term counts n(t) come from a second pass over all texts that emits only terms
which a bit filter of fixed size may hold, so the vocabulary is never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Stages, slices

#: Words on either side of an entity that count as near.
WINDOW = 10
#: Texts that the estimate holds against a pair: a pair in one text has two thirds of its disclosure, in five texts ten elevenths.
DOUBT = 0.5
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.6, 0.9
#: Bits of the filter of terms to count for each such term, and its bounds (2 and 32 MB); all are powers of two.
BITS_PER_TERM, FILTER_BITS, MOST_BITS = 16, 1 << 24, 1 << 28

# The base kinds in the order in which they are listed, their patterns, and what replaces them.
KINDS = ["email", "ip", "card", "phone", "general", "removed"]
BASE = 4
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def folded(match: str) -> str:
    """The term that a match counts as, in the contexts and in the counts of all texts alike."""
    return match.lower()


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match starts with the whole run of local characters before its @, so @ is looked for first."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted; code points, end exclusive."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def contexts(text: str, spans: list[tuple[int, int, int]], window: int = WINDOW
             ) -> tuple[list[str], list[tuple[str, str, int, int, bool]]]:
    """Entities of a text, and (entity, term, start, end, first) for terms near one; first: the pair's first in the text."""
    if not spans:
        return [], []
    covered = sorted((s, e) for s, _, e in spans)
    words, k = [], 0
    reach = 0
    for m in _TERM.finditer(text):
        while k < len(covered) and covered[k][0] < m.end():
            reach = max(reach, covered[k][1])
            k += 1
        if m.start() >= reach:
            words.append((m.start(), m.end(), folded(m.group())))
    starts = np.array([w[0] for w in words])
    entities, near, seen = {}, {}, set()
    for s, kind, e in spans:
        entity = xxhash.xxh3_128_hexdigest(f"{kind}:{text[s:e].lower()}")
        entities[entity] = None
        i = int(np.searchsorted(starts, s)) if len(words) else 0
        for a, b, term in words[max(0, i - window): i + window]:
            near.setdefault((entity, term, a, b))
    rows = []
    for entity, term, a, b in near:
        rows.append((entity, term, a, b, (entity, term) not in seen))
        seen.add((entity, term))
    return list(entities), rows


_CONTEXT = "array<struct<entity: string, term: string, start: int, end: int, first: boolean>>"
_SPANS = "array<struct<start: int, kind_no: int, end: int>>"


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, t, base, entities, near) for every row: spans and contexts, no text."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("first", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column(2).to_pylist()
            base = [base_spans(t) for t in texts]
            found = [contexts(t, s, window) if s else ([], []) for t, s in zip(texts, base)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([[{"start": s, "kind_no": k, "end": e} for s, k, e in x] for x in base], span),
                 pa.array([e for e, _ in found], pa.list_(pa.string())),
                 pa.array([[dict(zip(("entity", "term", "start", "end", "first"), r)) for r in n] for _, n in found], near)],
                names=["doc_id", "t", "base", "entities", "near"])

    return docs.mapInArrow(run, f"doc_id long, t long, base {_SPANS}, entities array<string>, near {_CONTEXT}")


def _slots(term: str, bits: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(term, 42)
    return h & (bits - 1), (h >> 32) & (bits - 1)


def _term_counts(texts: DataFrame, pairs: DataFrame, stages: Stages) -> DataFrame:
    """(term, n_t): documents of each term that may be among ``pairs``; every text is read, others emit nothing."""
    spark = texts.sparkSession
    terms = stages.put(pairs.select("term").distinct(), "terms")
    size = min(MOST_BITS, max(FILTER_BITS, 1 << (BITS_PER_TERM * terms.count()).bit_length()))
    h = F.xxhash64("term")
    at = F.explode(F.array(h.bitwiseAND(F.lit(size - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(size - 1))))
    got = (terms.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w"))
           .agg(F.expr("bit_or(shiftleft(1L, CAST(b & 63 AS INT)))").alias("m")).toArrow())
    bits = np.zeros(size // 64, np.int64)
    bits[got["w"].to_numpy()] = got["m"].to_numpy()
    shared = spark.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             names=["term", "n"])
            counts.clear()
            return out

        for b in slices(batches, "text"):
            of: dict[str, bool] = {}
            for text in b.column(0).to_pylist():
                for term in {folded(w) for w in set(_TERM.findall(text))} if text else ():
                    ok = of.get(term)
                    if ok is None:
                        x, y = _slots(term, size)
                        ok = of[term] = bool(data[x >> 3] >> (x & 7) & 1 and data[y >> 3] >> (y & 7) & 1)
                    if ok:
                        counts[term] += 1
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosures(scan: DataFrame, texts: DataFrame, stages: Stages, doubt: float = DOUBT, least: float = GENERALISE
                ) -> DataFrame:
    """(entity, term, disclosure): pairs at or above ``least``, from counts over all documents.

    n_et, n_e and n_t count documents, copies among them; n_texts the different texts that show the pair.
    """
    near = scan.where("size(near) > 0").select("t", F.explode("near").alias("x")).select("t", "x.*")
    pairs = stages.put(near.where("first").groupBy("entity", "term", "t").agg(F.count("*").alias("n"))
                       .groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("n_texts")), "pairs")
    of_entity = scan.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    total = scan.agg(F.count("*").cast("double").alias("n"))
    known = (pairs.join(_term_counts(texts, pairs, stages), "term", "left").join(of_entity, "entity").crossJoin(F.broadcast(total))
             .withColumn("disclosure", F.expr("try_divide(ln(n * n_et / (n_e * n_t)), ln(n / n_e))")
                         * (F.col("n_texts") / (F.col("n_texts") + F.lit(doubt)))))
    return known.where(F.col("disclosure") >= least).select("entity", "term", "disclosure")


def find(docs: DataFrame, window: int = WINDOW, doubt: float = DOUBT, generalise: float = GENERALISE,
         remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, base, spans) for every row of ``docs``: arrays of struct<start, kind_no, end>; spans: base and terms.

    * null or empty text: empty arrays; very long texts are read whole; null doc_id: kept;
    * matches of different kinds may overlap and all stay; terms inside a base span are not terms;
    * a term near several entities is judged by the one that it discloses most; equal texts count as documents each, but
      as one text for the weight of what they show;
    * repeated rows: the same answer each; empty table: empty result; extra columns are not read.
    """
    stages = Stages(docs.sparkSession, "privacy")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), "text")
    scan = stages.put(_scan(rows, window), "scan")
    known = stages.put(disclosures(scan, rows, stages, doubt, generalise), "disclosures")
    near = (scan.where("size(near) > 0").select("doc_id", "t", F.explode("near").alias("x"))
            .select("doc_id", "t", "x.entity", "x.term", "x.start", "x.end"))
    kind = F.when(F.max("disclosure") >= remove, F.lit(BASE + 1)).otherwise(F.lit(BASE))
    terms = (near.join(known, ["entity", "term"]).groupBy("doc_id", "t", "start", "end").agg(kind.alias("kind_no"))
             .groupBy(F.col("doc_id").alias("d"), F.col("t").alias("dt"))
             .agg(F.collect_list(F.struct("start", "kind_no", "end")).alias("terms")))
    out = scan.select("doc_id", "t", "base").join(
        terms, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")), "left")
    return out.select("doc_id", "t", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(
        F.sort_array(F.concat("base", "terms"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The spans as (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    names = F.array(*map(F.lit, KINDS))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.get(names, x["kind_no"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = [F.expr(f"CAST(size(filter(base, x -> x.kind_no = {i})) AS LONG)").alias(f"n_{k}")
             for i, k in enumerate(KINDS[:BASE])]
    return found.select("doc_id", *count, F.sha2(text(F.col("base")), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


def rewrite(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind's label; spans that overlap are one, with the first's label."""
    if not text or not spans:
        return text
    out, end = [], 0
    for start, kind, stop in sorted(spans):
        if start >= end:
            out += [text[end:start], LABELS[kind]]
        end = max(end, stop)
    return "".join(out) + text[end:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with personal data replaced by labels and disclosing terms generalised or removed."""
    found = Stages(docs.sparkSession, "sanitise").put(
        find(docs, id_col=id_col, text_col=text_col, **options).where("size(spans) > 0")
        .groupBy("doc_id", "t").agg(F.first("spans").alias("spans")), "spans").toDF("__did", "__t", "__spans")

    @F.arrow_udf("string")
    def replace(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([rewrite(t, [(x["start"], x["kind_no"], x["end"]) for x in s or ()])
                         for t, s in zip(text.to_pylist(), spans.to_pylist())], pa.string())

    joined = docs.join(found, docs[id_col].cast("long").eqNullSafe(found["__did"])
                       & (F.xxhash64(docs[text_col].cast("string")) == found["__t"]), "left")
    return joined.select(*[replace(F.col(f"`{c}`"), F.col("__spans")).alias(c) if c == text_col else F.col(f"`{c}`")
                           for c in docs.columns])
