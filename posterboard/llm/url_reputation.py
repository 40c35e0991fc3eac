"""URL filters: rules by host and path, and empirical-Bayes host reputation for what no rule decides.

Labelled outcomes of pages are counted per host. A beta-binomial prior goes down the levels: all hosts -> suffix ->
registered domain -> host. Each level's posterior mean becomes the next one's prior mean, worth ``strength`` page outcomes,
the strength being fitted by the method of moments to how the children of that level differ.
A url is blocked if the lower bound of its host's posterior bad rate, mean - z * sd, is over a limit. A host, domain or suffix without labelled pages has its parent's
mean, worth the prior's strength, and is judged by the same bound: a new host under a domain known to be bad is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name, table, written

#: (pattern, verdict); the longest that fits wins.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
Z = 1.645
#: Blocked if the posterior bad rate is over this many times the rate of all pages (and over MIN_BAD), with the certainty of Z.
MIN_BAD = 0.2
TIMES = 1.25
#: Bounds of a fitted prior strength, in page outcomes.
STRENGTH = (2.0, 200.0)


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' for a null url or one without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and the start of the path."""
    rule = verdict = None
    for pattern, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = pattern.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, pattern) if rule is None else rule.when(fits, pattern)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    return F.when(host == "", host).otherwise(F.substring_index(host, ".", -2))


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(level: str) -> str:
    """Method of moments over a parent's children: how many outcomes the parent's mean is worth to each of them."""
    return f"""
      SELECT parent, p, children, CASE WHEN var_between > 0 THEN least({STRENGTH[1]}, greatest({STRENGTH[0]}, p * (1 - p) / var_between - 1)) ELSE {STRENGTH[1]} END AS strength
      FROM (SELECT parent, p, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS children,
                   (sum(CASE WHEN n > 0 THEN n * pow(bad / n - p, 2) ELSE 0 END) - (sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) - 1) * p * (1 - p)) / nullif(sum(n) - sum(n * n) / nullif(sum(n), 0), 0) AS var_between
            FROM {level} GROUP BY parent, p)"""


def _posterior(level: str, k: str) -> str:
    """mean and total (in outcomes) of a child's posterior. A prior is worth no more than what is known of the parent; an only child is its parent, whose outcomes are the same."""
    prior = f"least({k}.strength, {level}.worth)"
    return f"""
      CASE WHEN {k}.children = 1 AND {level}.n > 0 AND {level}.parent <> '' THEN {level}.p ELSE ({level}.bad + {prior} * {level}.p) / ({level}.n + {prior}) END AS mean,
      CASE WHEN {k}.children = 1 AND {level}.n > 0 AND {level}.parent <> '' THEN {level}.worth ELSE {level}.n + {prior} END AS total"""


#: Labelled outcomes of each host: 0 for hosts without any.
HOSTS_SQL = "SELECT host, domain, suffix, coalesce(sum(CAST(bad AS DOUBLE)), 0) AS bad, CAST(count(bad) AS DOUBLE) AS n FROM page GROUP BY host, domain, suffix"
#: Plain SQL on both engines: h(host, domain, suffix, bad, n) -> the result.
REPUTATION_SQL = f"""
d AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d GROUP BY suffix),
g AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS p0 FROM s),
s1 AS (SELECT '' AS parent, suffix, bad, n, (SELECT p0 FROM g) AS p, CAST({STRENGTH[1]} AS DOUBLE) AS worth FROM s),
ks AS ({_strength("s1")}),
s2 AS (SELECT suffix, {_posterior("s1", "ks")} FROM s1 JOIN ks ON s1.parent = ks.parent),
d1 AS (SELECT d.suffix AS parent, d.domain, d.bad, d.n, s2.mean AS p, s2.total AS worth FROM d JOIN s2 ON d.suffix = s2.suffix),
kd AS ({_strength("d1")}),
d2 AS (SELECT d1.domain, {_posterior("d1", "kd")} FROM d1 JOIN kd ON d1.parent = kd.parent),
h1 AS (SELECT h.domain AS parent, h.host, h.bad, h.n, d2.mean AS p, d2.total AS worth FROM h JOIN d2 ON h.domain = d2.domain),
kh AS ({_strength("h1")}),
h2 AS (SELECT h1.host, {_posterior("h1", "kh")} FROM h1 JOIN kh ON h1.parent = kh.parent),
rep AS (SELECT host, mean, mean - {Z} * sqrt(mean * (1 - mean) / (total + 1)) AS low FROM h2),
judged AS (SELECT host, mean AS bad_rate, CASE WHEN low > (SELECT greatest({MIN_BAD}, {TIMES} * p0) FROM g) THEN 'block' ELSE 'allow' END AS verdict FROM rep)"""


def host_reputation(pages: DataFrame) -> DataFrame:
    """pages: host, domain, suffix, bad (0, 1, null where unlabelled). Returns host, bad_rate, verdict for each host. Repeated rows count each.

    The hosts are a table of their own, as each level of the model reads them several times.
    """
    hosts = written(pages.sparkSession.sql(HOSTS_SQL.replace("FROM page", "FROM {page}"), page=pages), "hosts")
    return pages.sparkSession.sql("WITH h AS (SELECT * FROM {h}), " + REPUTATION_SQL + " SELECT host, bad_rate, verdict FROM judged", h=hosts)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages: page_id, url, bad (0, 1 or null: the page's labelled outcome). Adds host, path, rule, bad_rate, verdict, in place of columns of these names.

    A null or unparsable url has the empty host, which is judged as any other host. Of rules of one length the first by name wins. Repeated rows are
    judged each, and count each. A very long url is taken whole. Other columns pass through; an empty table gives no rows. The reputation is joined by host as an
    ordinary join, so a host with a third of all pages can be split.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    pages = pages.drop("host", "path", "rule", "bad_rate", "verdict")
    said_name, reputation = free_name(pages, "rule_verdict"), free_name(pages, "reputation")
    pages = pages.withColumns({"host": host, "path": path})
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, said_name: said})
    hosts = pages.select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "bad")
    out = pages.join(host_reputation(hosts).withColumnRenamed("verdict", reputation), "host", "left")
    return out.withColumn("verdict", F.coalesce(said_name, reputation)).drop(said_name, reputation)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, bad: a page's url ends in the id of the document made from it, whose label is the page's outcome.

    bad is 1 for low quality or toxic documents. Of repeated labels the worst counts; ids that are no numbers have no label.
    """
    bad = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    doc = F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') AS BIGINT)")
    pages = pages.select("page_id", "url", doc.alias("doc_id"))
    return pages.join(bad, "doc_id", "left").select("page_id", "url", "bad")


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = (
    r"""
WITH bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
u AS (SELECT page_id, url,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
  TRY_CAST(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') AS BIGINT) AS doc_id FROM pages),
rules(pattern, h, p, v) AS (VALUES """
    + ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)
    + r"""),
hit AS (SELECT page_id, arg_max(pattern, length(pattern)) AS rule, arg_max(v, length(pattern)) AS rule_verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
page AS (SELECT u.page_id, host, path, rule, rule_verdict, bad.bad,
  CASE WHEN host = '' THEN '' ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain, list_last(string_split(host, '.')) AS suffix
  FROM u LEFT JOIN hit USING (page_id) LEFT JOIN bad ON u.doc_id = bad.doc_id),
h AS ("""
    + HOSTS_SQL
    + "), "
    + REPUTATION_SQL
    + r"""
SELECT page_id, page.host, path, rule, coalesce(rule_verdict, verdict) AS verdict FROM page LEFT JOIN judged ON page.host = judged.host
"""
)
