"""URL filters: allow and block rules, and empirical-Bayes reputation of hosts where none fits. SQL functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: (host, path, verdict); a rule's name is its host and path together.
RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")
]
#: Public suffixes of two labels that the split of a host knows; all others are taken to have one.
TWO_LABELS = [
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au",
    "or.jp", "org.au", "org.uk"
]
WORSE = 2.0  # times the usual odds of a bad page, from which on a host is blocked
Z = 1.645


def suffixes_from(spark: SparkSession, path: str) -> list[str]:
    """The suffixes of two labels in a text file of public suffixes, one a line; comments begin with //, rules with * or ! are left out."""
    lines = spark.read.text(path).select(F.trim(F.regexp_extract("value", r"^[^/\s]*", 0)).alias("s"))
    return sorted(r.s for r in lines.where(F.rlike("s", F.lit(r"^[^.*!]+\.[^.*!]+$"))).distinct().collect())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ://, up to /, ? or #, with A-Z lower-cased. Path: from there to ? or #.

    Both are empty where url is null or has no ://.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does. The rules become one CASE."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def with_parents(hosts: DataFrame, two_labels: list[str]) -> DataFrame:
    """hosts with domain, the registered domain of host, and suffix, its public suffix."""
    labels = F.split(F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", ""), r"\.")
    n = F.size("labels")
    tail = lambda k: F.array_join(F.slice("labels", F.greatest(F.lit(1), n - k + 1), F.lit(k)), ".")
    k = F.when((n >= 2) & tail(F.lit(2)).isin(two_labels), 2).otherwise(1)
    x = hosts.withColumn("labels", labels).withColumn("k", k)
    return x.withColumn("suffix", tail(F.col("k"))).withColumn("domain", tail(F.col("k") + 1)).drop("labels", "k")


def _strength(children: DataFrame) -> float:
    """Prior strength by the method of moments, from rows (good, n, m): how much children differ from m."""
    v = F.col("m") * (1 - F.col("m"))
    off, pairs = F.sum((F.col("good") - F.col("n") * F.col("m")) ** 2 - F.col("n") * v), F.sum(F.col("n") * (F.col("n") - 1) * v)
    r = children.where("n > 0").agg(off.alias("off"), pairs.alias("pairs")).first()
    rho = min(0.5, max(0.005, r.off / r.pairs)) if r.pairs else 0.05
    return (1 - rho) / rho


def reputations(outcomes: DataFrame, two_labels: list[str], scratch: Scratch) -> DataFrame:
    """(host, a, b): each host's beta posterior, from outcomes (host, n, good), one row a host.

    The share of good pages is shrunk from host to registered domain to suffix to all pages: each level's
    prior has the mean of the level above and a strength estimated from how far that level's rates spread.
    Hosts without labelled pages have their domain's prior.
    """
    x = scratch.table(with_parents(outcomes, two_labels))
    by = lambda c: x.groupBy(*c).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = x.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    m0 = (total[1] + 1) / (total[0] + 2)
    shrunk = lambda s: (F.col("good") + s * F.col("m")) / (F.col("n") + s)
    suffixes = by(["suffix"]).withColumn("m", F.lit(m0))
    suffixes = scratch.table(suffixes.select("suffix", shrunk(_strength(suffixes)).alias("m")))
    domains = by(["suffix", "domain"]).join(suffixes, "suffix")
    domains = scratch.table(domains.select("suffix", "domain", shrunk(_strength(domains)).alias("m")))
    hosts = x.join(domains, ["suffix", "domain"])
    s = _strength(hosts)
    return hosts.select("host", (F.col("good") + s * F.col("m")).alias("a"), (F.col("n") - F.col("good") + s * (1 - F.col("m"))).alias("b"))


def upper_bound(a: Column, b: Column, z: float = Z) -> Column:
    """The upper quantile of a beta distribution that z stands for, by its log-odds, which are nearly normal: below 1."""
    return 1 / (1 + F.exp(-(F.log(a / b) + z * F.sqrt(1 / a + 1 / b))))


def least_good(share: Column, worse: float = WORSE) -> Column:
    """The share of good pages at which the odds of a bad one are `worse` times those at share."""
    return share / (share + worse * (1 - share))


def verdicts(hosts: DataFrame, two_labels: list[str], scratch: Scratch, worse: float = WORSE) -> DataFrame:
    """(host, usual): block where a host's share of good pages is surely under least_good() of all pages, else allow.

    hosts is (host, n, good): each host's labelled pages, and the good ones among them.
    """
    found = reputations(hosts, two_labels, scratch)
    total = hosts.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("share"))
    bound = least_good(F.lit(total.first().share), worse)
    return found.select("host", F.when(upper_bound(F.col("a"), F.col("b")) < bound, "block").otherwise("allow").alias("usual"))


def _marks(labels: DataFrame) -> DataFrame:
    own = labels.where("page_id is not null and good is not null").groupBy(F.col("page_id").alias("m_id"))
    return own.agg(F.max(F.col("good").cast("int")).alias("good"))


def _outcomes(marked: DataFrame) -> DataFrame:
    return marked.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))


def judge(
    pages: DataFrame, labels: DataFrame, scratch: Scratch, rules: list[tuple[str, str, str]] = RULES, two_labels: list[str] = TWO_LABELS,
    worse: float = WORSE
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url).

    The longest fitting rule decides. Elsewhere a page is blocked if its host's odds of a bad page are surely over
    `worse` times those of all labelled pages: if the posterior's upper bound says so. labels (page_id, good) are
    the labelled outcomes; a page labelled more than once is good if any label says so, and each row of a page
    that comes more than once counts. Null urls and urls without :// share the empty host, which is judged as any
    host. Repeated pages are judged alike, urls of any length are read whole, ties of rules can't be, for the
    longest name wins and no two are equal. Without labels all is allowed outside the rules; an empty table
    gives an empty result; columns besides page_id and url are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    x = scratch.table(pages.select("page_id", host.alias("host"), path.alias("path")))
    marked = x.join(_marks(labels), F.col("page_id") == F.col("m_id"), "left")
    known = verdicts(_outcomes(marked), two_labels, scratch, worse)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return x.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "usual").alias("verdict"))


def measured(
    pages: DataFrame, labels: DataFrame, scratch: Scratch, two_labels: list[str] = TWO_LABELS, worse: float = WORSE, folds: int = 5
) -> DataFrame:
    """(usual, pages, bad): what the reputations learned from the other folds say of each fold's labelled pages; no page's own label counts."""
    host, _ = host_and_path(F.col("url"))
    x = pages.select("page_id", host.alias("host")).join(_marks(labels), F.col("page_id") == F.col("m_id"))
    x = scratch.table(x.select("host", "good", F.pmod(F.xxhash64("page_id"), F.lit(folds)).alias("fold")))
    out = None
    for k in range(folds):
        known = verdicts(_outcomes(x.withColumn("good", F.when(F.col("fold") != k, F.col("good")))), two_labels, scratch, worse)
        own = x.where(F.col("fold") == k).join(known, "host")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("usual").agg(F.count(F.lit(1)).alias("pages"), F.sum(1 - F.col("good")).alias("bad"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; the outcome of a page is the quality label of the document with its id."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(pages, labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")), Scratch(spark, "op6"))


def _level(name: str, table: str, by: str, mean: str) -> str:
    """One level of the shrinkage in SQL: its counts, its strength, and its shrunk means."""
    return f"""
{name}_n AS (SELECT {by}, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY {by}),
{name}_m AS (SELECT {name}_n.*, {mean} AS m FROM {name}_n{table}),
{name}_s AS (SELECT CASE WHEN pairs > 0 THEN least(0.5::DOUBLE, greatest(0.005::DOUBLE, off / pairs)) ELSE 0.05::DOUBLE END AS rho FROM (
  SELECT sum((good - n * m) ** 2 - n * m * (1 - m)) AS off, sum(n * (n - 1) * m * (1 - m)) AS pairs FROM {name}_m WHERE n > 0)),
{name} AS (SELECT {name}_m.* EXCLUDE (m), m AS above, (1 - rho) / rho AS s, (good + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS m FROM {name}_m, {name}_s)"""


SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
x AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
marks AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good FROM x LEFT JOIN marks ON page_id = doc_id GROUP BY host),
labelled AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM counted),
parted AS (SELECT *, CASE WHEN len(l) >= 2 AND l[-2] || '.' || l[-1] IN ({", ".join(f"'{t}'" for t in TWO_LABELS)}) THEN 2 ELSE 1 END AS k FROM labelled),
hosts AS (SELECT host, CAST(n AS DOUBLE) AS n, CAST(good AS DOUBLE) AS good, array_to_string(l[greatest(1, len(l) - k + 1):], '.') AS suffix,
          array_to_string(l[greatest(1, len(l) - k):], '.') AS domain FROM parted),
{_level("suffixes", "", "suffix", "(SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM hosts)")},
{_level("domains", " JOIN suffixes USING (suffix)", "suffix, domain", "suffixes.m")},
{_level("each", " JOIN domains USING (suffix, domain)", "suffix, domain, host", "domains.m")},
share AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM hosts),
usual AS (SELECT host, CASE WHEN 1 / (1 + exp(-(ln(a / b) + {Z} * sqrt(1 / a + 1 / b)))) < share.m / (share.m + {WORSE} * (1 - share.m)) THEN 'block' ELSE 'allow' END AS verdict
          FROM (SELECT host, good + s * above AS a, n - good + s * (1 - above) AS b FROM each), share),
rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
         FROM x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT x.page_id, x.host, path, rule, coalesce(best.verdict, usual.verdict) AS verdict
FROM x JOIN usual ON x.host = usual.host LEFT JOIN best ON x.page_id = best.page_id
"""
