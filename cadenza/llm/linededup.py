"""Line deduplication by distinct-site spread.

A line that stands on many sites is boilerplate. Per line hash a HyperLogLog
sketch of its sites is built in every task and merged by aggregation, so a line
that a third of all documents hold costs one sketch per task. Lines whose
estimate lies near the threshold get an exact distinct count. A boilerplate
line stays at its first place (smallest doc_id, then position) and is removed
from everywhere else.

How many sites make a line boilerplate may depend on its length (``passages``): a long passage
goes from few sites on, a sentence from a share of all sites, and what is shorter, such as a code token, a list
mark or "Yes.", only together with a longer line next to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Stages

#: Distinct sites from which a line is boilerplate in op9's query and its SQL; the pipeline's stage takes fewer.
MIN_SITES = 10
#: Base-2 logarithm of a sketch's registers; the relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Standard errors (one site at least) around the threshold within which a line is counted exactly.
BAND = 6.0

#: Of ``dedup_passages``: words of a long line and of a sentence, sites at least, and the share of all sites from
#: which lines that are not long are boilerplate.
LONG_WORDS, SENTENCE_WORDS, FEW_SITES, SITE_SHARE = 20, 5, 3, 0.001
#: Lines next to each other are at most so many places apart: one blank line may stand between them.
NEXT = 2

#: Parts of each line's rows that are joined apart from one another.
SALT = 16

_KEY = ["h1", "h2"]


def line_size(line: Column) -> Column:
    """2 for a long line, 1 for a sentence, 0 for a shorter one.

    A long line counts its blanks. A sentence counts words of letters alone, with punctuation around them,
    which most code and marks are not; only lines that aren't long are looked at so closely. In a line mostly of
    characters of three bytes or more, two characters of a script without blanks are one word of either kind.
    """
    bare = F.when(F.octet_length(line) > 2 * F.char_length(line), F.floor(F.regexp_count(line, F.lit(
        r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]")) / 2)).otherwise(0)
    words = F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1 + bare
    plain = F.regexp_count(line, F.lit(
        r"(?<!\S)[\p{Ps}\p{Pi}\"']*[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*[\p{Pe}\p{Pf}\"'.,;:!?…]*(?!\S)")) + bare
    return F.when(words >= LONG_WORDS, 2).when(plain >= SENTENCE_WORDS, 1).otherwise(0)


def line_rows(docs: DataFrame, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id",
              words: bool = False) -> DataFrame:
    """(doc_id, t, pos, site, h1, h2): one row per line that is not blank; t and (h1, h2) hash the text and the line.

    Blanks, tabs and carriage returns around a line do not count. A null site is one site of its own. With ``words``
    also size: 2 for a long line, 1 for a sentence, 0 for a shorter one.
    """
    size = [line_size(F.col("line")).alias("size")] if words else []
    line = F.trim(F.col("line"), F.lit(" \t\r"))
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        F.col(site_col).cast("string").alias("site"))
            .select("doc_id", F.xxhash64("text").alias("t"), F.coalesce("site", F.lit("")).alias("site"),
                    F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
            .withColumn("line", line).where("line <> ''")
            .select("doc_id", "t", "pos", "site", F.xxhash64("line").alias("h1"),
                    F.xxhash64(F.lit(1), "line").alias("h2"), *size))


def _joined(lines: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """``lines`` joined with a table of some lines by hash; a line's rows are dealt into ``SALT`` parts, so one that a
    third of all documents hold is not one task's work."""
    salted = lines.withColumn("__salt", F.expr(f"CAST(pmod(xxhash64(doc_id, pos), {SALT}) AS INT)"))
    parts = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(parts, [*_KEY, "__salt"], how).drop("__salt")


def boilerplate(lines: DataFrame, stages: Stages, min_sites: int = MIN_SITES, lg_k: int = LG_K,
                band: float = BAND) -> DataFrame:
    """(h1, h2, first): lines on ``min_sites`` or more distinct sites and their first place (doc_id, pos)."""
    width = max(1.0, band * 1.04 / math.sqrt(2 ** lg_k) * min_sites)
    spread = stages.put(
        lines.groupBy(*_KEY)
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
             F.min(F.struct("doc_id", "pos")).alias("first"))
        .where(F.col("sites") >= math.floor(min_sites - width)), "spread")
    sure = spread.where(F.col("sites") > min_sites + width)
    near = spread.where(F.col("sites") <= min_sites + width)
    exact = (_joined(lines, near, "left_semi").groupBy(*_KEY).agg(F.countDistinct("site").alias("n"))
             .where(F.col("n") >= min_sites).select(*_KEY))
    return sure.select(*_KEY, "first").union(near.join(exact, _KEY, "left_semi").select(*_KEY, "first"))


def removals(docs: DataFrame, stages: Stages, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND,
             text_col: str = "text", site_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, t, removed): positions of the lines to take out of each document that has any."""
    lines = stages.put(line_rows(docs, text_col, site_col, id_col), "lines")
    bad = boilerplate(lines, stages, min_sites, lg_k, band)
    return (_joined(lines, bad).where("NOT (doc_id <=> first.doc_id AND pos = first.pos)")
            .groupBy("doc_id", "t").agg(F.collect_set("pos").alias("removed")))


def passages(docs: DataFrame, stages: Stages, few_sites: int = FEW_SITES, site_share: float = SITE_SHARE, lg_k: int = LG_K,
             band: float = BAND, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, t, removed) as ``removals``, with thresholds by length; see ``dedup_passages``."""
    lines = stages.put(line_rows(docs, text_col, site_col, id_col, words=True), "lines")
    sites = lines.select("site").distinct().count()
    many = max(few_sites, math.ceil(site_share * sites))
    bad = boilerplate(lines.where("size = 2"), stages, few_sites, lg_k, band).withColumn("solid", F.lit(True)).union(
        boilerplate(lines.where("size < 2"), stages, many, lg_k, band).withColumn("solid", F.lit(None).cast("boolean")))
    hits = (_joined(lines, bad).where("NOT (doc_id <=> first.doc_id AND pos = first.pos)")
            .select("doc_id", "t", "pos", F.coalesce("solid", F.col("size") == 1).alias("solid")).distinct())
    along = Window.partitionBy("doc_id", "t").orderBy("pos")
    runs = hits.withColumn("new", F.coalesce(F.col("pos") - F.lag("pos").over(along) > NEXT, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(along))
    kept = runs.withColumn("whole", F.max("solid").over(Window.partitionBy("doc_id", "t", "run"))).where("whole")
    return kept.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("removed"))


def dedup_passages(docs: DataFrame, few_sites: int = FEW_SITES, site_share: float = SITE_SHARE, lg_k: int = LG_K,
                   band: float = BAND, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``dedup_lines`` with thresholds that follow a line's length and the number of sites in the table.

    A long line (``line_size``) is boilerplate from ``few_sites`` sites on; any other from ``site_share`` of all
    sites on, at least ``few_sites``. One that is not even a sentence (code, marks, "Yes.") goes only from places where it
    stands in a run of such lines that holds a longer one. Everything else is as ``dedup_lines`` says.
    """
    stages = Stages(docs.sparkSession, "linededup")
    return _without(docs, passages(docs, stages, few_sites, site_share, lg_k, band, text_col, site_col, id_col), text_col, id_col)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND,
                text_col: str = "text", site_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with cross-site boilerplate lines taken out of the text, plus ``n_lines`` and ``n_removed``.

    All columns of ``docs`` stay (a column of one of those two names gives way); n_chars, if there, is counted anew.

    * null text: stays null, 0 lines; empty text: one blank line, nothing removed; blank lines always stay;
    * a text all of whose lines go becomes empty, the row stays;
    * a line that repeats within the document of its first place goes there too, but for that first place;
    * repeated rows (same doc_id and text): both hold the first place, both keep the line;
    * null doc_id sorts before all others; null site: one site of its own; empty table: empty result.
    """
    stages = Stages(docs.sparkSession, "linededup")
    return _without(docs, removals(docs, stages, min_sites, lg_k, band, text_col, site_col, id_col), text_col, id_col)


def _without(docs: DataFrame, removed: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``docs`` without the lines at the removed positions of (doc_id, t, removed), with ``n_lines`` and ``n_removed``."""
    out = removed.toDF("__lid", "__lt", "__removed")
    kept = F.expr(f"transform(array(split(`{text_col}`, '\n', -1)), l -> "
                  "array_join(transform(array_except(sequence(0, size(l) - 1), __removed), i -> l[i]), '\n'))[0]")
    base = docs.drop("n_lines", "n_removed")
    joined = base.join(out, base[id_col].cast("long").eqNullSafe(out["__lid"]) & (F.xxhash64(base[text_col]) == out["__lt"]),
                       "left")
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(kept)
    cols = [text.alias(c) if c == text_col else F.char_length(text).cast("long").alias(c) if c == "n_chars"
            else F.col(f"`{c}`") for c in base.columns]
    n_lines = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    return joined.select(*cols, F.coalesce(n_lines, F.lit(0)).cast("int").alias("n_lines"),
                         F.coalesce(F.size("__removed"), F.lit(0)).alias("n_removed"))


ORACLE = f"""
WITH l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
           FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS line_key FROM l),
b AS (SELECT line_key FROM k WHERE line_key <> '' GROUP BY 1 HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES}),
r AS (SELECT k.*, b.line_key IS NOT NULL
               AND row_number() OVER (PARTITION BY k.line_key ORDER BY doc_id, pos) > 1 AS gone
      FROM k LEFT JOIN b USING (line_key)),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
      FROM r GROUP BY doc_id)
SELECT o.doc_id, d.text, coalesce(d.n_lines, 0) AS n_lines, coalesce(d.n_removed, 0) AS n_removed
FROM documents o LEFT JOIN d USING (doc_id)
"""
