"""Generic frame operators: column hygiene, filters, set operations and
one-pass census aggregates (P1-P14, U1-U4, A2, A9-A13, A15, A24)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAG_COLUMNS = ["is_english", "lyrics_available", "matched_mood"]


def add_col_if_absent(df: DataFrame, col: str, value) -> DataFrame:
    """Add a constant column only if it does not exist yet."""
    return df if col in df.columns else df.withColumn(col, F.lit(value))


def prefix_filter(df: DataFrame, col: str, prefix: str | None) -> DataFrame:
    """P2 (dropping form): keep rows whose lower-case ``col`` starts with the prefix."""
    if not prefix:
        return df
    return df.where(F.lower(F.col(col)).startswith(prefix.lower()))


def flag_cascade(df: DataFrame, flags: list[str] = FLAG_COLUMNS, drop: bool = False) -> DataFrame:
    """P3 + P6: keep rows with every flag = 1, optionally drop the flags."""
    cond = reduce(lambda a, b: a & b, [F.col(f) == 1 for f in flags])
    out = df.where(cond)
    return out.drop(*flags) if drop else out


def exclude_containing(df: DataFrame, col: str, words: list[str]) -> DataFrame:
    """Drop rows whose ``col`` contains any of ``words`` (substring)."""
    cond = reduce(lambda a, b: a | b, [F.col(col).contains(w) for w in words])
    return df.where(~F.coalesce(cond, F.lit(False)))


def open_range(df: DataFrame, col: str, bottom=None, top=None) -> DataFrame:
    """``bottom < col < top``, either bound optional, both strict."""
    if top is not None:
        df = df.where(F.col(col) < top)
    if bottom is not None:
        df = df.where(F.col(col) > bottom)
    return df


def every_kth(df: DataFrame, order_col: str, k: int = 8, limit: int = 10) -> DataFrame:
    """Rows whose position (0-based, by ``order_col``) is a multiple of k,
    first ``limit`` of them. The position is the key itself when the key is a
    dense index; the ``limit`` is the feature (a preview), done as top-k."""
    return df.where(F.pmod(F.col(order_col), F.lit(k)) == 0).orderBy(order_col).limit(limit)


def null_census(df: DataFrame) -> DataFrame:
    """NULL count per column in one pass, long form (column, n_null)."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return wide.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, n_null)")


def contains_count(df: DataFrame, col: str, word: str) -> Column:
    """P13 helper: count of non-null rows whose lower-case text contains ``word``."""
    return F.count_if(F.col(col).isNotNull() & F.lower(F.col(col)).contains(word.lower()))


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Union all, columns aligned by name, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedupe_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per ``key``, the winner chosen by an explicit order
    (``min_by`` aggregate, partial-aggregated; no window over a hot key)."""
    others = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in others])
    ordering = F.struct(*order)
    return (df.groupBy(key).agg(F.min_by(packed, ordering).alias("_w"))
            .select(key, "_w.*"))


#: Leaves of the fingerprints: ranges of the rows' hash.
LEAVES = 65536


def _row_hash(df: DataFrame, seed: int) -> Column:
    """Hash of a whole row; NULL differs from every value."""
    return F.xxhash64(F.lit(seed), *[F.struct(F.col(f"`{c}`"), F.col(f"`{c}`").isNull()) for c in df.columns])


def _fingerprints(df: DataFrame, side: int) -> DataFrame:
    """(leaf, n, s1, s2) per leaf: rows and the sums of two hashes of them, whatever their order."""
    h1, h2 = _row_hash(df, 1), _row_hash(df, 2)
    leaf = F.pmod(h1, F.lit(LEAVES)).cast("int")
    signed = lambda c: F.lit(side).cast("decimal(1,0)") * c.cast("decimal(20,0)")
    return df.select(leaf.alias("leaf"), signed(F.lit(1)).alias("n"), signed(h1).alias("s1"), signed(h2).alias("s2"))


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """The leaves in which the two bags differ, one scan a side.

    Every leaf has the difference of the sides' counts and hash sums; at most as many rows as leaves are shuffled. Bags with
    the same fingerprints count as equal: for different ones 128 bits of hash sums would have to agree in every leaf."""
    both = _fingerprints(a, 1).unionAll(_fingerprints(b, -1))
    return (both.groupBy("leaf").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
            .where("n <> 0 OR s1 <> 0 OR s2 <> 0").select("leaf"))


def frames_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: one row ``(n_left_only, n_right_only)``; both 0 means equal as bags.

    Fingerprints of the two sides are compared leaf by leaf, and only rows of differing leaves are
    shuffled and counted: by hash of the row, with the sides' copies of it."""
    common = a.unionAll(b).schema  # types of both sides widened
    a, b = (df.toDF(*[f"_{i}" for i in range(len(common))]).select(*[F.col(f"_{i}").cast(f.dataType) for i, f in enumerate(common)])
            for df in (a, b))
    leaves = F.broadcast(differing_leaves(a, b))  # at most LEAVES numbers

    def suspects(df: DataFrame, side: int) -> DataFrame:
        rows = df.select(*df.columns, F.pmod(_row_hash(df, 1), F.lit(LEAVES)).cast("int").alias("leaf"), F.lit(side).alias("_side"))
        return rows.join(leaves, "leaf", "left_semi")

    per_row = suspects(a, 1).unionAll(suspects(b, -1)).groupBy(*a.columns).agg(F.sum("_side").alias("d"))
    return per_row.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).cast("long").alias("n_left_only"),
                       F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).cast("long").alias("n_right_only"))


def class_counts(df: DataFrame, label: str = "mood") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def describe_numeric(df: DataFrame, col: str) -> DataFrame:
    """Count / mean / std / min / quartiles / max (exact percentiles)."""
    c = F.col(col)
    return df.agg(
        F.count(c).alias("count"),
        F.round(F.avg(c), 5).alias("mean"),
        F.round(F.stddev_samp(c), 5).alias("std"),
        F.min(c).cast("double").alias("min"),
        F.round(F.percentile(c, 0.25), 5).alias("p25"),
        F.round(F.percentile(c, 0.5), 5).alias("p50"),
        F.round(F.percentile(c, 0.75), 5).alias("p75"),
        F.max(c).cast("double").alias("max"),
    )


def length_cutoff(df: DataFrame, col: str = "wordcount") -> DataFrame:
    """``int(75th percentile)`` with linear interpolation, one row."""
    return df.agg(F.floor(F.percentile(F.col(col), 0.75)).cast("int").alias("cutoff"))


def filter_funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows at start, rows lost per cumulative step (negative), rows left.
    One pass of ``count_if`` over cumulative conjunctions, then ``stack``."""
    aggs = [F.count(F.lit(1)).alias("s0")]
    cond = F.lit(True)
    for i, (_, c) in enumerate(steps):
        cond = cond & F.coalesce(c, F.lit(False))
        aggs.append(F.count_if(cond).alias(f"s{i + 1}"))
    wide = df.agg(*aggs)
    parts = ["'start', 0, s0"]
    for i, (name, _) in enumerate(steps):
        parts.append(f"'{name}', {i + 1}, s{i + 1} - s{i}")
    parts.append(f"'remaining', {len(steps) + 1}, s{len(steps)}")
    return wide.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (step, step_ord, n)")


def first_char_census(df: DataFrame, col: str) -> DataFrame:
    """Rows per first character of ``col``."""
    return df.groupBy(F.substring(F.col(col), 1, 1).alias("first_char")).agg(
        F.count(F.lit(1)).alias("n"))
