"""URL filters: rules first, then an empirical-Bayes reputation of the host. DataFrame operations only.

Labelled page outcomes (good or not) are summed by host. Beta-binomial priors shrink them down the tree: the suffix towards
all pages, the registered domain towards its suffix, the host towards its domain. How strongly is estimated from the data, by the
method of moments from how much the children differ. A page passes if its host's posterior mean less `z` standard
deviations reaches the floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, hot_join, settle, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The lowest posterior bound that passes, and how many posterior standard deviations it is below the mean.
FLOOR, Z = 0.5, 1.0
#: Bounds of an estimated prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 200.0

#: Suffixes of two labels under which domains are registered. Fixed values.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr",
    "com.tw", "edu.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)


def host_of(url: Column) -> Column:
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """The public suffix of a host, two labels if it is one of SUFFIXES, and the registered domain, one label more; user and port do not count."""
    name = F.regexp_replace(host, "^.*@|:[0-9]*$", "")
    two = F.substring_index(name, ".", -2).isin(*SUFFIXES)
    return F.when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1)), F.when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def shrink(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Adds prior (the parent's posterior mean), strength, mean and variance to children with n and k; parents: key, mean.

    strength is the moment estimate of a beta-binomial: with between-children variance v of the rates around the prior's mean m and
    binomial noise m(1-m)/n, it is m(1-m)/v' - 1, v' being v less the noise; within WEAKEST and STRONGEST.
    """
    sizes = children.groupBy(key).agg(F.count("*").alias("children"))
    joined = hot_join(children, parents.select(key, F.col("mean").alias("prior")).join(sizes, key), key, "children")
    noise = F.col("prior") * (1 - F.col("prior"))
    fit = joined.filter("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("prior"), 2)).alias("spread"), F.sum(noise).alias("noise"), F.sum(F.col("n") * noise).alias("scale"), F.sum("n").alias("all"))
    between = (F.col("spread") - F.col("noise")) / F.col("all")
    strength = F.coalesce(F.when(between > 0, F.col("scale") / F.col("all") / between - 1), F.lit(STRONGEST))
    fit = fit.select(F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), strength)).alias("strength"))
    a, b = F.col("prior") * F.col("strength") + F.col("k"), (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("k")
    return joined.crossJoin(F.broadcast(fit)).withColumn("mean", a / (a + b)).withColumn("variance", a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1)))


def reputations(pages: DataFrame) -> DataFrame:
    """host, pages, n, k -> one row for each host with its posterior: prior, strength, mean, variance. pages: host, good (0, 1 or null)."""
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = settle(hosts.withColumns({"domain": domain, "suffix": suffix}), "url-hosts")
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = total(hosts, "domain", "suffix")
    suffixes = total(domains, "suffix").withColumn("top", F.lit(""))
    top = total(suffixes, "top").select("top", ((F.col("k") + 1) / (F.col("n") + 2)).alias("mean"))
    suffixes = settle(shrink(suffixes, top, "top"), "url-suffixes")
    domains = settle(shrink(domains, suffixes, "suffix"), "url-domains")
    return shrink(hosts, domains, "domain")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, floor: float = FLOOR, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, n, k, mean, bound for every row of pages(page_id, url).

    outcomes: page_id, good (1 or 0), one row for each labelled page. Null urls and those without `://` have an empty host and path
    and share one reputation. Hosts without labels get their domain's. Without any label the prior is one half, and no host reaches
    the floor by its bound: everything without a rule is blocked. No pages: no rows. Other columns are ignored.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = outcomes.filter("page_id IS NOT NULL AND good IS NOT NULL").groupBy(F.col("page_id").alias("_id")).agg(F.min("good").alias("good"))
    parsed = settle(parsed.join(labelled, F.col("page_id") == F.col("_id"), "left").drop("_id"), "url-pages")
    hosts = settle(reputations(parsed), "url-reputations")
    bound = F.col("mean") - F.lit(float(z)) * F.sqrt("variance")
    hosts = hosts.select("host", "pages", "n", "k", "mean", bound.alias("bound"))
    judged = hot_join(parsed.drop("good"), hosts, "host", "pages", "inner")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") >= floor, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "n", "k", "mean", "bound")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's number in its path is the id of the document it shows; that document's quality label is the page's outcome."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    shown = pages.select("page_id", F.expr("try_cast(regexp_extract(url, '://[^?#]*?/([0-9]+)', 1) AS BIGINT)").alias("doc_id"))
    outcomes = shown.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("page_id", "good")
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _shrunk(children: str, parents: str, key: str) -> str:
    """The SQL of shrink()."""
    return f"""
  SELECT *, a / (a + b) AS mean, a * b / (pow(a + b, 2) * (a + b + 1)) AS variance FROM (
    SELECT *, prior * strength + k AS a, (1 - prior) * strength + n - k AS b FROM (
      SELECT c.*, p.mean AS prior FROM {children} c LEFT JOIN {parents} p ON c.{key} = p.{key}),
      (SELECT greatest({WEAKEST}::DOUBLE, least({STRONGEST}::DOUBLE, coalesce(CASE WHEN v > 0 THEN s / v - 1 END, {STRONGEST}::DOUBLE))) AS strength FROM (
        SELECT (sum(n * pow(k / n - prior, 2)) - sum(prior * (1 - prior))) / sum(n) AS v, sum(n * prior * (1 - prior)) / sum(n) AS s
        FROM (SELECT c.*, p.mean AS prior FROM {children} c LEFT JOIN {parents} p ON c.{key} = p.{key}) WHERE n > 0)))"""


SQL = f"""
WITH labelled AS (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id),
cutted AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
    TRY_CAST(nullif(regexp_extract(url, '://[^?#]*?/([0-9]+)', 1), '') AS BIGINT) AS doc FROM pages),
parsed AS (
  SELECT page_id, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, good
  FROM cutted LEFT JOIN labelled ON doc = doc_id),
hosts AS (
  SELECT host, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS k,
    string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS labels,
    CASE WHEN array_to_string(list_slice(labels, -2, -1), '.') IN {SUFFIXES} THEN 2 ELSE 1 END AS w,
    array_to_string(list_slice(labels, -1 - w, -1), '.') AS domain, array_to_string(list_slice(labels, -w, -1), '.') AS suffix
  FROM parsed GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, '' AS top, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
tops AS (SELECT top, (sum(k) + 1) / (sum(n) + 2) AS mean FROM suffixes GROUP BY top),
s AS ({_shrunk('suffixes', 'tops', 'top')}),
d AS ({_shrunk('domains', 's', 'suffix')}),
h AS ({_shrunk('hosts', 'd', 'domain')}),
ruled AS (
  SELECT parsed.page_id, parsed.host, parsed.path, mean - {Z} * sqrt(variance) AS bound,
    CASE WHEN (parsed.host = 'example.net' OR parsed.host LIKE '%.example.net') AND starts_with(parsed.path, '/en/') THEN 'example.net/en/'
      WHEN (parsed.host = 'example.com' OR parsed.host LIKE '%.example.com') AND starts_with(parsed.path, '/de/') THEN 'example.com/de/'
      WHEN (parsed.host = 'org' OR parsed.host LIKE '%.org') AND starts_with(parsed.path, '/fr/') THEN 'org/fr/'
      WHEN (parsed.host = 'net' OR parsed.host LIKE '%.net') AND starts_with(parsed.path, '/') THEN 'net/' END AS rule
  FROM parsed JOIN h ON h.host = parsed.host)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN bound >= {FLOOR} THEN 'allow' ELSE 'block' END AS verdict
FROM ruled
"""
