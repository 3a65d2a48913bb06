"""Secret scan with multipart credential linking, DataFrame functions only.

Each pattern's matches and the gaps before them come from ``regexp_extract_all`` and
``split``; running sums of their lengths give code-point offsets. Strong
matches (the base kinds) are reported by themselves. Weak parts of a credential -
account names, short or bare secrets, endpoints - are reported only if a
complementary part stands within ``REACH`` characters in the same scope
(paragraph). That interval join is a sweep in position order: the
nearest part of each role before and after, never the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Stages

#: Characters between two parts of one credential.
REACH = 200

# The base kinds' patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ["assign", "access", "hex"]

IDENT = r"""\b(?i:user(?:name)?|login|client_?id|access_?key_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
WEAK = r"""\b(?i:pwd|pass|passphrase|auth|credential|private_?key|access_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
BARE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"""\b[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s"'<>]+"""
BREAK = r"\n[ \t\r]*\n"

_KEY = ["doc_id", "t"]


def _has(low: str, *words: str) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(F.col(low), F.lit(w))
    return cond


def _found(pattern: str, when: Column, kind: str) -> Column:
    """struct(kind, gaps, matches) of the leftmost matches that don't overlap, null unless ``when``."""
    p = F.lit(pattern)
    return F.when(when, F.struct(
        F.lit(kind).alias("kind"), F.transform(F.split("text", pattern, -1), F.char_length).alias("gaps"),
        F.regexp_extract_all("text", p, F.lit(0)).alias("matches")))


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, found): every row of ``docs`` with the matches of each pattern."""
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .select("doc_id", F.xxhash64("text").alias("t"), "text", F.lower("text").alias("low")))
    assign = _has("low", "password", "passwd", "secret", "token", "apikey", "api_key")
    ident = _has("low", "user", "login", "client", "access", "account")
    weak = _has("low", "pwd", "pass", "auth", "credential", "key")
    url = F.contains("text", F.lit("://"))
    access = F.contains("text", F.lit("AKIA"))
    rows = rows.select("*", assign.alias("c_assign"), ident.alias("c_ident"), weak.alias("c_weak"), url.alias("c_url"),
                       access.alias("c_access"), F.col("text").rlike(HEX).alias("c_hex"))
    partner = F.expr("c_ident OR c_access OR c_url")
    found = [_found(ASSIGN, F.col("c_assign"), "assign"), _found(ACCESS, F.col("c_access"), "access"),
             _found(HEX, F.col("c_hex"), "hex"), _found(IDENT, F.col("c_ident"), "ident"),
             _found(WEAK, F.col("c_weak") & partner, "weak"), _found(BARE, partner, "bare"),
             _found(ENDPOINT, F.col("c_url"), "endpoint"), _found(BREAK, partner, "break")]
    keep = F.filter(F.array(*found), lambda x: x.isNotNull() & (F.size(x["matches"]) > 0))
    return rows.select("doc_id", "t", keep.alias("found"))


def _placed(parts: DataFrame) -> DataFrame:
    """(doc_id, t, kind, start, end, role): one row per part, kinds resolved, offsets in code points, end exclusive."""
    rows = (parts.where(F.size("found") > 0).distinct().select(*_KEY, F.explode("found").alias("f"))
            .select(*_KEY, "f.kind", F.posexplode(F.arrays_zip(
                F.slice("f.gaps", F.lit(1), F.size("f.matches")).alias("gap"), F.col("f.matches").alias("match"))))
            .select(*_KEY, "kind", "pos", F.col("col.gap").alias("gap"), F.col("col.match").alias("match"))
            .withColumn("len", F.char_length("match")))
    along = Window.partitionBy(*_KEY, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(along)
    value = F.regexp_extract("match", ASSIGN, 1)
    kind = (F.when(F.expr("kind = 'assign'") & (F.char_length(value) < 12), F.lit("weak"))
            .when(F.expr("kind = 'access' AND len < 18"), F.lit(None)).otherwise(F.col("kind")))
    role = F.expr("""CASE WHEN kind IN ('access', 'ident') THEN 'id' WHEN kind = 'endpoint' THEN 'endpoint'
                     WHEN kind = 'break' THEN 'break' ELSE 'secret' END""")
    return (rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).withColumn("kind", kind)
            .where("kind IS NOT NULL").select(*_KEY, "kind", "start", "end").distinct().withColumn("role", role))


def _linked(placed: DataFrame, reach: int) -> DataFrame:
    """The weak parts (ident, weak, bare, endpoint) that have a complementary part within reach in their scope."""
    order = ["start", "end", "kind"]
    doc = Window.partitionBy(*_KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scoped = (placed.withColumn("scope", F.sum(F.expr("CAST(role = 'break' AS INT)")).over(doc)).where("role <> 'break'"))
    up = Window.partitionBy(*_KEY, "scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = (Window.partitionBy(*_KEY, "scope").orderBy(*[F.desc(c) for c in order])
            .rowsBetween(Window.unboundedPreceding, -1))

    def near(secret: bool) -> Column:
        mine = F.expr("role = 'secret'" if secret else "role <> 'secret'")
        return F.coalesce(F.col("start") - F.max(F.when(mine, F.col("end"))).over(up) <= reach, F.lit(False)) | F.coalesce(
            F.min(F.when(mine, F.col("start"))).over(down) - F.col("end") <= reach, F.lit(False))

    return (scoped.withColumn("by_secret", near(True)).withColumn("by_other", near(False))
            .where("kind IN ('ident', 'weak', 'bare', 'endpoint') AND IF(role = 'secret', by_other, by_secret)")
            .select(*_KEY, "kind", "start", "end"))


def scan(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, linked) for every row of ``docs``: arrays of struct<start, kind_no, end, kind>, sorted.

    base: kinds assign (value of 12 or more characters), access (18 or more), hex (16 or more). linked: kinds ident,
    weak, bare and endpoint with a complementary part: names and endpoints need a secret, weak secrets a name or endpoint.

    * null or empty text: empty arrays; very long texts are scanned whole; null doc_id: kept;
    * matches that touch or coincide in different kinds are all reported; repeated rows: the same answer each;
    * empty table: empty result; extra columns are not read.
    """
    stages = Stages(docs.sparkSession, "secrets")
    parts = stages.put(_parts(docs, id_col, text_col), "parts")
    placed = stages.put(_placed(parts), "placed")
    kinds = BASE_KINDS + ["ident", "weak", "bare", "endpoint"]
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int")
    base = placed.where(F.col("kind").isin(BASE_KINDS)).select(*_KEY, "kind", "start", "end", F.lit(True).alias("is_base"))
    all_spans = base.unionByName(_linked(placed, reach).withColumn("is_base", F.lit(False)))
    span = F.struct("start", number.alias("kind_no"), "end", "kind")
    per_doc = all_spans.groupBy(*_KEY).agg(
        F.sort_array(F.collect_list(F.when(F.col("is_base"), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(~F.col("is_base"), span))).alias("linked"))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "base", "linked")
    none = F.array().cast(per_doc.schema["base"].dataType)
    return (parts.select("doc_id", "t").join(
        per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")), "left")
        .select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("linked", none).alias("linked")))


def digest(found: DataFrame) -> DataFrame:
    """The scan as (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *count, F.sha2(text(F.col("base")), 256).alias("base_sha256"),
                        text(F.sort_array(F.concat("base", "linked"))).alias("spans"))
