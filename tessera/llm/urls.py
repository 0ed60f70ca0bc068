"""Host reputation by empirical Bayes, with hand-written rules ahead of it.

Labelled outcomes of pages are counted by host. Rates are shrunk level by level: a
suffix towards the whole, a registered domain towards its suffix, a host towards its
domain. The strength of each level's beta prior comes from how much the rates of its
members differ beyond chance. A host is blocked if the lower bound of its posterior
rate of bad pages is above a limit; a host without labels has that of its prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: The rules of the query, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Second labels under which names are registered one level further down.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Standard deviations below the posterior mean of the bound, and what it must exceed.
Z, LIMIT = 1.64, 0.5
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null or one without ``://``. Only A-Z are lower-cased."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path joined) and its verdict, or nulls."""
    name, verdict = F, F
    for h, p, v in sorted(rules, key=lambda x: (-len(x[0] + x[1]), -len(x[0]), x[0] + x[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = name.when(fits, h + p), verdict.when(fits, v)
    return (name.otherwise(F.lit(None).cast("string")), verdict.otherwise(F.lit(None).cast("string"))) if rules else (F.lit(None).cast("string"),) * 2


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host. An address of digits is its own domain and suffix."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    deep = (n >= 3) & F.get(parts, n - 2).isin(SECOND_LEVEL) & (F.length(F.get(parts, n - 1)) == 2)
    numeric = host.rlike(r"^[0-9.:\[\]]*$")
    suffix = F.when(deep, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(numeric, host).otherwise(domain), F.when(numeric, host).otherwise(suffix)


def _strength(members: DataFrame, prior: Column) -> Column:
    """Prior strength by moments: how far members' rates spread about ``prior`` beyond binomial chance.

    Over members with n pages and y bad ones, sum (y - n p)^2 = p(1-p) (sum n + rho sum n(n-1))
    in expectation, with rho = 1 / (strength + 1).
    """
    p = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    spread = F.sum((F.col("y") - F.col("n") * p) * (F.col("y") - F.col("n") * p) / (p * (1 - p)))
    pairs = F.sum(F.col("n") * (F.col("n") - 1))
    rho = F.when(pairs > 0, (spread - F.sum("n")) / F.when(pairs > 0, pairs))
    return F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(STRONGEST)


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, labelled, bad, prior, strength, rate, bound) of each host.

    outcomes: (host, bad) rows with bad 0 or 1, or null for a host to judge without a label;
    null hosts are left out. A host without labels changes no rate and no strength; it gets
    its domain's rate, or its suffix's or the whole's, as its prior. Hosts are counted once
    and written; every level is grouped from the counts of the one below, so a host that
    holds most pages is one row after the first, map-side combined aggregation.
    """
    hosts = outcomes.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("y"))
    domain, suffix = levels(F.col("host"))
    hosts = stored(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    # Add-one keeps the whole's rate inside (0, 1) and defined when nothing is labelled.
    whole = suffixes.agg(((F.coalesce(F.sum("y"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("p0"))
    with_whole = suffixes.join(F.broadcast(whole))  # one row
    s0 = with_whole.agg(_strength(with_whole, F.col("p0")).alias("s0"))
    suffixes = with_whole.join(F.broadcast(s0)).select("suffix", ((F.col("y") + F.col("s0") * F.col("p0")) / (F.col("n") + F.col("s0"))).alias("p1"))
    with_suffix = domains.join(suffixes, "suffix")
    s1 = with_suffix.agg(_strength(with_suffix, F.col("p1")).alias("s1"))
    domains = with_suffix.join(F.broadcast(s1)).select("domain", ((F.col("y") + F.col("s1") * F.col("p1")) / (F.col("n") + F.col("s1"))).alias("p2"))
    with_domain = hosts.join(domains, "domain")
    s2 = with_domain.agg(_strength(with_domain, F.col("p2")).alias("s2"))
    a, b = F.col("y") + F.col("s2") * F.col("p2"), F.col("n") - F.col("y") + F.col("s2") * (1 - F.col("p2"))
    rate = a / (a + b)
    return with_domain.join(F.broadcast(s2)).select(
        "host", F.col("n").cast("long").alias("labelled"), F.col("y").cast("long").alias("bad"),
        F.col("p2").alias("prior"), F.col("s2").alias("strength"), rate.alias("rate"),
        (rate - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound"),
    )


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the rule that fits, verdict, and its host's bound.

    labels: (page_id, bad), bad 0 or 1; a page may have several or none. A rule's verdict
    goes before the method's; a host without labelled pages is judged by its prior. A url that is null or has no ``://`` has an empty host and path and the
    verdict of the empty host. Null ids keep their row and have no label; repeated rows
    give repeated rows; an empty table gives none. Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    found = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labelled = found.select("page_id", "host").join(labels.select("page_id", F.col("bad").cast("int").alias("bad")), "page_id").select("host", "bad")
    outcomes = labelled.unionByName(found.select("host", F.lit(None).cast("int").alias("bad")))
    known = reputation(outcomes).select(F.col("host").alias("known"), "labelled", "rate", "bound")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # Skewed hosts are split by the adaptive join; the table of hosts has one row each.
    return found.join(known, F.col("host") == F.col("known"), "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("labelled", F.lit(0).cast("long")).alias("labelled"), F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"),
    )


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), f AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), o AS (
  SELECT host, count(l.doc_id)::DOUBLE AS n, coalesce(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) FILTER (l.doc_id IS NOT NULL), 0)::DOUBLE AS y
  FROM f LEFT JOIN (SELECT * FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) l ON l.doc_id = page_id GROUP BY host
), h0 AS (
  SELECT *, string_split(host, '.') AS q, regexp_matches(host, '^[0-9.:\[\]]*$') AS num FROM o
), h AS (
  SELECT host, n, y,
    CASE WHEN num THEN host ELSE array_to_string(q[greatest(1, len(q) - CASE WHEN deep THEN 2 ELSE 1 END):], '.') END AS domain,
    CASE WHEN num THEN host ELSE array_to_string(q[greatest(1, len(q) - CASE WHEN deep THEN 1 ELSE 0 END):], '.') END AS suffix
  FROM (SELECT *, len(q) >= 3 AND len(q[-1]) = 2 AND q[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AS deep FROM h0)
), d AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL
), s AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM d GROUP BY ALL
), w AS (SELECT (coalesce(sum(y), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM s
), k0 AS (SELECT sum((y - n * p) ** 2 / (p * (1 - p))) - sum(n) AS a, sum(n * (n - 1)) AS b FROM s, w
), s1 AS (SELECT suffix, (y + m * p) / (n + m) AS p FROM s, w, (SELECT CASE WHEN b > 0 AND a > 0 THEN least(greatest(b / a - 1, 1), 1000) ELSE 1000 END AS m FROM k0)
), k1 AS (SELECT sum((y - n * p) ** 2 / (p * (1 - p))) - sum(n) AS a, sum(n * (n - 1)) AS b FROM d JOIN s1 USING (suffix)
), d1 AS (SELECT domain, (y + m * p) / (n + m) AS p FROM d JOIN s1 USING (suffix), (SELECT CASE WHEN b > 0 AND a > 0 THEN least(greatest(b / a - 1, 1), 1000) ELSE 1000 END AS m FROM k1)
), k2 AS (SELECT sum((y - n * p) ** 2 / (p * (1 - p))) - sum(n) AS a, sum(n * (n - 1)) AS b FROM h JOIN d1 USING (domain)
), z AS (
  SELECT host, n, y + m * p AS a, n - y + m * (1 - p) AS b
  FROM h JOIN d1 USING (domain), (SELECT CASE WHEN b > 0 AND a > 0 THEN least(greatest(b / a - 1, 1), 1000) ELSE 1000 END AS m FROM k2)
), r AS (
  SELECT host, n, a / (a + b) AS rate, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM z
), v AS (
  SELECT page_id, f.host, path, n, rate, bound, CASE
    WHEN (f.host = 'example.net' OR f.host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (f.host = 'example.com' OR f.host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (f.host = 'org' OR f.host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (f.host = 'net' OR f.host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM f LEFT JOIN r ON f.host = r.host
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(n, 0)::BIGINT AS labelled, round(rate, 6) AS rate, round(bound, 6) AS bound
FROM v
"""
