"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and public
suffix. From the root down each level's bad rate is a beta-binomial posterior
whose prior is centred on its parent's mean; the prior's strength is the level's
over-dispersion, estimated from all counts of the level. A host is
blocked when the lower bound of its posterior bad rate exceeds the threshold.
Rules written by hand come first, the longest that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Stages

# Rules (host, then path); suffixes of two labels: registries' labels under any country, those of some
# countries alone, and hosts whose subdomains have owners of their own.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]
REGISTRY_LABELS = ["ac", "co", "com", "edu", "gob", "gov", "govt", "mil", "net", "org", "sch"]
TWO_LABEL_SUFFIXES = [
    "ltd.uk", "me.uk", "nhs.uk", "plc.uk", "police.uk", "asn.au", "id.au", "geek.nz", "gen.nz", "iwi.nz", "kiwi.nz", "maori.nz",
    "school.nz", "ad.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp", "go.kr", "ne.kr", "or.kr", "pe.kr", "re.kr",
    "firm.in", "gen.in", "ind.in", "nic.in", "res.in", "go.id", "or.id", "web.id", "go.th", "in.th", "mi.th", "or.th",
    "adv.br", "art.br", "blog.br", "eco.br", "eng.br", "ind.br", "jus.br", "leg.br", "med.br", "tv.br", "law.za", "nom.za",
    "web.za", "bel.tr", "gen.tr", "k12.tr", "web.tr", "idv.tw", "idv.hk", "muni.il", "k12.il", "asso.fr", "gouv.fr", "nom.fr",
    "or.at", "gv.at", "info.pl", "waw.pl", "msk.ru", "spb.ru", "in.ua", "kiev.ua", "go.ke", "ne.ke", "or.ke", "go.tz", "or.tz",
    "blogspot.com", "wordpress.com", "tumblr.com", "weebly.com", "wixsite.com", "herokuapp.com", "appspot.com", "substack.com",
    "github.io", "gitlab.io", "netlify.app", "vercel.app", "web.app", "firebaseapp.com", "pages.dev", "workers.dev",
    "azurewebsites.net", "cloudfront.net", "readthedocs.io", "fly.dev", "onrender.com", "repl.co", "neocities.org",
]
#: Bad rate above which a host is blocked, and how many posterior standard deviations must lie above it.
THRESHOLD, DEVIATIONS = 0.3, 1.0
#: Range of a prior's strength (pseudo-outcomes), when a level shows no or full over-dispersion.
STRENGTH = (1.0, 1000.0)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host between the first :// and the next /, ? or #, A-Z lower-cased; path up to ? or #."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def levels(host: Column, labels: list[str] = REGISTRY_LABELS, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; without user and port. An address is its own domain, with no suffix.

    A suffix has two labels if it is one of ``suffixes``, or one of ``labels`` under a country (a last label of two letters).
    """
    bare = F.regexp_replace(host, "^.*@|:[0-9]*$", "")
    parts = F.split(bare, "\\.")
    two = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(bare)
    country = two.rlike(r"^[^.]*\.[a-z]{2}$") & F.split_part(two, F.lit("."), F.lit(1)).isin(labels)
    long = two.isin(suffixes) | country
    address = bare.rlike("^[0-9.]+$") | F.startswith(bare, F.lit("["))
    domain = F.when(address, bare).when(long & (F.size(parts) > 2), F.array_join(F.slice(parts, -3, 3), ".")).otherwise(two)
    suffix = F.when(address, F.lit("")).when(long, two).otherwise(F.element_at(parts, -1))
    return domain, suffix


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, null if none: host or subdomain, path by prefix."""
    if not rules:
        return F.lit(None).cast("struct<verdict: string, rule: string>")
    ordered = sorted(dict((r, v) for v, r in rules).items(), key=lambda x: (-len(x[0]), x[0]))
    listed = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"),
                                F.lit(r.partition("/")[0]).alias("host"),
                                F.lit("".join(r.partition("/")[1:])).alias("path")) for r, v in ordered])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
                    & F.startswith(path, r["path"]))
    return F.try_element_at(fits, F.lit(1))


def _shrunk(child: DataFrame, strength: tuple[float, float]) -> DataFrame:
    """Adds a, b: the beta posterior of each row (n, k outcomes) whose prior has the mean m.

    Strength by moments: (k - n m)^2 exceeds n m (1 - m) by n (n - 1) m (1 - m) rho in the mean, rho = 1 / (strength + 1).
    """
    one = child.agg(F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2
                          - F.col("n") * F.col("m") * (1 - F.col("m"))).alias("over"),
                    F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m"))).alias("most"))
    low, high = 1 / (strength[1] + 1), 1 / (strength[0] + 1)
    rho = F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), F.try_divide("over", "most"))), F.lit(low))
    one = one.select((1 / rho - 1).alias("s"))
    return (child.crossJoin(F.broadcast(one))
            .withColumn("a", F.col("k") + F.col("s") * F.col("m")).withColumn("b", F.col("n") - F.col("k") + F.col("s") * (1 - F.col("m")))
            .drop("s"))


def reputation(outcomes: DataFrame, stages: Stages, strength: tuple[float, float] = STRENGTH) -> dict[str, DataFrame]:
    """Posteriors from (host, domain, suffix, n, k) per host: tables 'host', 'domain', 'suffix' (key, a, b) and 'root' (m)."""
    hosts = outcomes.where("n > 0")
    root = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("m"))
    total = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    out = {"root": root}
    suffix = hosts.groupBy("suffix").agg(*total).crossJoin(F.broadcast(root))
    out["suffix"] = stages.put(_shrunk(suffix, strength).select("suffix", "a", "b"), "suffix")
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("m")
    domain = hosts.groupBy("domain", "suffix").agg(*total).join(out["suffix"].select("suffix", mean), "suffix")
    out["domain"] = stages.put(_shrunk(domain, strength).select("domain", "suffix", "a", "b"), "domain")
    host = hosts.join(out["domain"].select("domain", "suffix", mean), ["domain", "suffix"])
    out["host"] = stages.put(_shrunk(host, strength).select("host", "a", "b"), "host")
    return out


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD,
          deviations: float = DEVIATIONS, strength: tuple[float, float] = STRENGTH, labels: list[str] = REGISTRY_LABELS,
          suffixes: list[str] = TWO_LABEL_SUFFIXES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate) for every row of ``pages``; ``outcomes``: (page_id, bad) with bad 0 or 1.

    A host without outcomes takes its domain's posterior, then its suffix's, then the root's mean.

    * null url or one without ://: host and path empty; null or unknown page_id in either table: no outcome from it;
    * several outcomes for a page: bad if any is; null outcomes don't count; repeated pages: judged each, counted each;
    * rules of equal length: the one that sorts first; no outcome at all: the root's rate is 1/2, nothing is blocked;
    * empty table: empty result; extra columns are not read.
    """
    stages = Stages(pages.sparkSession, "urls")
    host, path = parse(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"))
    seen = (outcomes.select(F.col("page_id").cast("long"), F.col("bad").cast("int")).where("page_id IS NOT NULL AND bad IS NOT NULL")
            .groupBy("page_id").agg(F.max("bad").alias("bad")))
    domain, suffix = levels(F.col("host"), labels, suffixes)
    per_host = (rows.join(seen, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
                .withColumn("domain", domain).withColumn("suffix", suffix))
    per_host = stages.put(per_host, "hosts")
    known = reputation(per_host, stages, strength)
    beta = per_host.select("host", "domain", "suffix")
    for level, keys in (("host", ["host"]), ("domain", ["domain", "suffix"]), ("suffix", ["suffix"])):
        beta = beta.join(known[level].select(*keys, F.struct("a", "b").alias(f"at_{level}")), keys, "left")
    beta = beta.crossJoin(F.broadcast(known["root"])).withColumn("at", F.coalesce("at_host", "at_domain", "at_suffix"))
    a, b = F.col("at.a"), F.col("at.b")
    low = a / (a + b) - deviations * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    beta = beta.select("host", F.coalesce(a / (a + b), F.col("m")).alias("bad_rate"),
                       F.coalesce(low > threshold, F.lit(False)).alias("blocked"))
    by_rule = rule(F.col("host"), F.col("path"), rules)
    return (rows.join(beta, "host").withColumn("r", by_rule)
            .select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
                    "bad_rate"))


def _prior(child: str) -> str:
    low, high = 1 / (STRENGTH[1] + 1), 1 / (STRENGTH[0] + 1)
    return f"""(SELECT 1 / coalesce(greatest({low!r}, least({high!r},
        CASE WHEN sum(n * (n - 1) * m * (1 - m)) <> 0 THEN sum((k - n * m) ** 2 - n * m * (1 - m))
             / sum(n * (n - 1) * m * (1 - m)) END)), {low!r}) - 1 FROM {child})"""


def _posterior(child: str, keys: str) -> str:
    return f"SELECT {keys}, k + s * m AS a, n - k + s * (1 - m) AS b FROM {child}, (SELECT {_prior(child)} AS s)"


def _fits() -> str:
    ordered = sorted(dict((r, v) for v, r in RULES).items(), key=lambda x: (-len(x[0]), x[0]))
    out = []
    for r, v in ordered:
        host, slash, path = r.partition("/")
        out.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{slash + path}') THEN '{v} {r}'")
    return "CASE " + " ".join(out) + " END"


#: Outcomes of pages in the query and its SQL: the labels of the same number, bad if of low quality or toxic.
ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
l AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic = 1) GROUP BY 1),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM p LEFT JOIN l USING (page_id) GROUP BY 1),
g AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS bare FROM c),
g2 AS (SELECT *, string_split(bare, '.') AS parts, regexp_matches(bare, '^[0-9.]+$') OR starts_with(bare, '[') AS address FROM g),
g3 AS (SELECT *, CASE WHEN len(parts) > 1 THEN array_to_string(parts[-2:], '.') ELSE bare END AS two FROM g2),
g4 AS (SELECT *, two IN ({", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)})
                 OR regexp_full_match(two, '({"|".join(REGISTRY_LABELS)})[.][a-z][a-z]') AS long FROM g3),
h AS (SELECT host, n, k,
        CASE WHEN address THEN bare WHEN long AND len(parts) > 2 THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
        CASE WHEN address THEN '' WHEN long THEN two ELSE parts[-1] END AS suffix FROM g4),
root AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h, root WHERE n > 0 GROUP BY 1),
s1 AS ({_posterior("s0", "suffix")}),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(a / (a + b)) AS m
       FROM h JOIN s1 USING (suffix) WHERE n > 0 GROUP BY 1, 2),
d1 AS ({_posterior("d0", "domain, suffix")}),
h0 AS (SELECT host, n, k, a / (a + b) AS m FROM h JOIN d1 USING (domain, suffix) WHERE n > 0),
h1 AS ({_posterior("h0", "host")}),
b AS (SELECT h.host, coalesce(h1.a, d1.a, s1.a) AS a, coalesce(h1.b, d1.b, s1.b) AS b FROM h
      LEFT JOIN h1 ON h.host = h1.host LEFT JOIN d1 ON h.domain = d1.domain AND h.suffix = d1.suffix
      LEFT JOIN s1 ON h.suffix = s1.suffix),
f AS (SELECT page_id, host, path, {_fits()} AS rule FROM p)
SELECT f.page_id, f.host, f.path, substr(rule, instr(rule, ' ') + 1) AS rule,
       coalesce(substr(rule, 1, instr(rule, ' ') - 1), CASE WHEN a / (a + b)
           - {DEVIATIONS!r} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {THRESHOLD!r} THEN 'block' ELSE 'allow' END) AS verdict
FROM f JOIN b ON f.host = b.host
"""
