"""URL filters (operator 6): explicit rules, then empirical-Bayes host reputation.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there
up to `?`, `#` or the end. A rule `domain/path` fits its domain and all subdomains if the
URL's path starts with the rule's path; the longest rule wins.

Where no rule fits, the host's reputation decides. Labelled pages (a label of the same id; bad
if toxic or of low quality) are counted by host. Each level's bad share is shrunk to the one
above it, host to registered domain to suffix to all, by a beta-binomial prior: its mean is
the parent's posterior mean, its strength follows from the children's overdispersion (method
of moments). A host is blocked if the lower bound of its posterior share of bad pages reaches
`block_from`; the bound is the normal approximation of the beta posterior's (mean less `z` deviations).

Null URLs and URLs without `://` have empty host and path and share the reputation of the
empty host. Pages without labels count nothing; of several labels of a page the worst holds.
Rows that repeat are counted as often as they occur. Only three numbers, the strengths, come
to the driver. Hosts are aggregated map-side; the join back is on the checked-out host table,
so a host with a third of the pages can be split. URLs of any length go through whole; an empty table
gives an empty one; input columns named as results are (in any case) are replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table, with_columns_of

#: The rules of the filter query (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Common public suffixes of two labels that registered domains may stand under.
TWO_LABEL_SUFFIXES = tuple(
    "ac.jp ac.nz ac.uk ac.za co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.bd com.br com.cn com.co com.eg com.hk com.mx com.my com.ng "
    "com.pe com.ph com.pk com.sa com.sg com.tr com.tw com.ua com.vn edu.au edu.cn edu.in gob.mx gov.au gov.br gov.cn gov.in gov.uk me.uk ne.jp net.au net.br net.cn "
    "net.nz or.jp or.kr org.au org.br org.cn org.il org.in org.mx org.nz org.tr org.tw org.uk org.za".split()
)


@dataclass(frozen=True)
class Bound:
    z: float = 1.645
    block_from: float = 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def strength(groups: DataFrame) -> float:
    """Prior strength of a level from its groups: `n`, `k` and the parent's mean `m`."""
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    over = F.sum(F.pow(k - n * m, 2) - n * m * (1 - m))
    room = F.sum(n * (n - 1) * m * (1 - m))
    row = groups.where("n > 0").agg(over.alias("over"), room.alias("room")).first()
    share = row["over"] / row["room"] if row["room"] else 0.0
    return 1.0 / min(0.99, max(0.0001, share)) - 1.0


def reputation(hosts: DataFrame) -> DataFrame:
    """`host`, `mean`, `deviation` of the posterior bad share; hosts has `host`, `n`, `k`."""
    levels = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = cut(levels.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    everywhere = ((total["k"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)

    def shrunk(groups: DataFrame) -> tuple[DataFrame, float]:
        s = strength(groups)
        return groups.withColumn("mean", (F.lit(s) * F.col("m") + F.col("k")) / (F.lit(s) + F.col("n"))), s

    suffixes, _ = shrunk(suffixes.withColumn("m", F.lit(everywhere)))
    domains, _ = shrunk(cut(domains.join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix")))
    found, s = shrunk(cut(levels.join(domains.select("suffix", "domain", F.col("mean").alias("m")), ["suffix", "domain"])))
    mean = F.col("mean")
    return found.select("host", "mean", F.sqrt(mean * (1 - mean) / (F.lit(s) + F.col("n") + 1)).alias("deviation"))


def judged(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, bound: Bound = Bound()) -> DataFrame:
    """`pages` with `host`, `path`, `rule`, `verdict` and the posterior's `bad_share`, `bad_from`."""
    located = with_columns_of(pages, {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id"))
    bad = bad.agg(F.max(F.greatest(F.col("toxic"), 1 - F.col("quality"))).alias("bad")).where("bad is not null")
    outcomes = located.select("page_id", "host").join(bad, "page_id", "left")
    hosts = cut(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("k")))
    known = cut(reputation(hosts))
    # Input columns may be named as the posterior's are: each side keeps a name of its own.
    joined = located.alias("l").join(known.alias("k"), F.col("l.host") == F.col("k.host"))
    rule, verdict = rule_of(F.col("l.host"), F.col("l.path"), rules)
    lowest = F.col("k.mean") - bound.z * F.col("k.deviation")
    own = F.when(lowest >= bound.block_from, "block").otherwise("allow")
    out = {"rule": rule, "verdict": F.coalesce(verdict, own), "bad_share": F.col("k.mean"), "bad_from": lowest}
    kept = [F.col(f"l.`{c}`") for c in located.columns if c.lower() not in out]
    return joined.select(*kept, *[v.alias(c) for c, v in out.items()])


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict", F.round("bad_share", 6).alias("bad_share"))


_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
SQL = r"""
WITH located AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM located
), bad AS (
  SELECT doc_id AS page_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels GROUP BY doc_id
), hosts AS (
  SELECT host, CASE WHEN two IN (""" + _SUFFIXES + r""") THEN two ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix,
    CASE WHEN two IN (""" + _SUFFIXES + r""") THEN regexp_extract(host, '([^.]*\.?[^.]*\.?[^.]*)$', 1) ELSE two END AS domain, count(bad) AS n, sum(coalesce(bad, 0)) AS k
  FROM (SELECT *, regexp_extract(host, '([^.]*\.?[^.]*)$', 1) AS two FROM parts) LEFT JOIN bad USING (page_id) GROUP BY host, two
), everywhere AS (
  SELECT (sum(k) + 1.0) / (sum(n) + 2.0) AS m FROM hosts
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM hosts, everywhere GROUP BY suffix
), s1 AS (
  SELECT 1.0 / least(0.99, greatest(0.0001, coalesce(sum(power(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1 AS s FROM suffixes WHERE n > 0
), suffix_means AS (
  SELECT suffix, (s * m + k) / (s + n) AS mean FROM suffixes, s1
), domains AS (
  SELECT h.suffix, domain, sum(n) AS n, sum(k) AS k, any_value(mean) AS m FROM hosts h JOIN suffix_means USING (suffix) GROUP BY h.suffix, domain
), s2 AS (
  SELECT 1.0 / least(0.99, greatest(0.0001, coalesce(sum(power(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1 AS s FROM domains WHERE n > 0
), domain_means AS (
  SELECT suffix, domain, (s * m + k) / (s + n) AS mean FROM domains, s2
), leaves AS (
  SELECT h.host, n, k, mean AS m FROM hosts h JOIN domain_means d ON h.suffix = d.suffix AND h.domain = d.domain
), s3 AS (
  SELECT 1.0 / least(0.99, greatest(0.0001, coalesce(sum(power(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1 AS s FROM leaves WHERE n > 0
), known AS (
  SELECT host, (s * m + k) / (s + n) AS mean, s + n AS total FROM leaves, s3
), rules(verdict, rule, domain, prefix) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
    ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), fitting AS (
  SELECT p.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.prefix) GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(mean, 6) AS bad_share
FROM parts p JOIN known USING (host) LEFT JOIN fitting f ON p.page_id = f.page_id
"""
