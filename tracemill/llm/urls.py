"""URL filters: host rules, and for all other pages a reputation of the host from labelled outcomes.

Outcomes of a host are binomial; their rate has a beta prior around the rate of the registered domain, that one around the
rate of the suffix, and that one around the rate of all. The strength of each level's prior comes from the data by
moments, but a prior weighs no more than the outcomes that it rests on, and a member's own outcomes are no part of its prior.
A page is blocked if the lower bound of its host's posterior share of bad pages is over a multiple of the share of all pages.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, cut

#: Rules are a short list, compiled into one expression.
MOST_RULES = 1000
#: Suffixes of two labels under which names are registered.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lowered; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host to the next ? or #; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last label, or the last two where names are registered under these."""
    name = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def url_domain(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix with one label more, if the host has one more."""
    name = F.regexp_replace(host, r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _deviance(level: DataFrame) -> DataFrame:
    """One row of sums over a level's members, each with n, bad and the prior rate p: x, noise, wide."""
    noise = F.col("p") * (1 - F.col("p"))
    return level.agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("p"), 2)).alias("x"), F.sum(noise).alias("noise"), F.sum(F.col("n") * noise).alias("wide"))


def _strength(level: DataFrame, least: float, most: float) -> float:
    """The strength of a level's prior, by moments: E[n (rate - p)^2] = p (1 - p) (1 + (n - 1) / (strength + 1))."""
    x, noise, wide = _deviance(level).first()
    if x is None or wide <= noise or x <= noise:
        return most
    return max(least, min(most, 1 / ((x - noise) / (wide - noise)) - 1))


def _apart(level: DataFrame, parent: DataFrame, by: str) -> DataFrame:
    """level with p and w: rate and weight of its parent without what the member itself adds to it."""
    above = parent.select(by, (F.col("n") + F.col("k")).alias("pn"), (F.col("bad") + F.col("k") * F.col("p")).alias("pb"))
    joined = level.join(above, by).withColumn("w", F.col("pn") - F.col("n"))
    return joined.withColumn("p", (F.col("pb") - F.col("bad")) / F.col("w")).drop("pn", "pb")


def _bound(mean: Column, weight: Column, z: float) -> Column:
    return F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (weight + 1)))


def _levels(outcomes: DataFrame, suffixes: Sequence[str], least: float, most: float) -> tuple:
    """(tops, domains, hosts, (rate, weight) of all, strengths by level). Each level has n, bad, p and k: rate and weight of its prior.

    A prior's weight is the strength of its level, but at most the weight of what is known of the parent without the member.
    """
    counts = outcomes.where("host is not null and host <> '' and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = cut(counts.withColumn("domain", url_domain(F.col("host"), suffixes)).withColumn("suffix", url_suffix(F.col("host"), suffixes)))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)) + 2, F.coalesce(F.sum("bad"), F.lit(0)) + 1).first()
    strengths = []

    def weighted(level: DataFrame) -> DataFrame:
        level = cut(level)
        strengths.append(_strength(level, least, most))
        return level.withColumn("k", F.least(F.lit(strengths[-1]), F.col("w")))

    tops = weighted(tops.withColumn("w", F.lit(float(n)) - F.col("n")).withColumn("p", (F.lit(float(bad)) - F.col("bad")) / F.col("w")))
    domains = weighted(_apart(domains, tops, "suffix"))
    hosts = weighted(_apart(hosts, domains, "domain"))
    return tops, domains, hosts, (bad / n, float(n)), strengths


def host_reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES, z: float = 1.645, least: float = 0.5, most: float = 200.0) -> DataFrame:
    """host, domain, suffix, n, bad, mean, low: for each host with a labelled page, posterior mean and lower bound of its share of bad pages.

    outcomes: host, bad (boolean); null hosts and outcomes are left out. low = mean - z * standard deviation, 0 at least.
    """
    hosts = _levels(outcomes, suffixes, least, most)[2]
    hosts = hosts.withColumn("mean", (F.col("bad") + F.col("k") * F.col("p")) / (F.col("n") + F.col("k")))
    return hosts.select("host", "domain", "suffix", "n", "bad", "mean", _bound(F.col("mean"), F.col("n") + F.col("k"), z).alias("low"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, lift: float = 1.25, suffixes: Sequence[str] = SUFFIXES, z: float = 1.645, least: float = 0.5, most: float = 200.0) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    The longest fitting rule decides; else a page is blocked if the lower bound of its host's posterior share of bad pages is over
    `lift` times the share of all labelled pages. A host without labelled pages has what is known of its domain as its posterior, or else
    of its suffix, or else of all pages. outcomes: url, bad. Other settings: as in host_reputation().

    A null url, or one without ://, has an empty host and path and is allowed if no rule fits. Repeated rows and null ids are judged as they come; with an
    empty table of outcomes only rules block, and an empty table of pages gives no rows. Other columns are not read.
    """
    judged = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    known = outcomes.select(url_host(F.col("url")).alias("host"), F.col("bad").cast("boolean").alias("bad"))
    tops, domains, hosts, (rate, weight), (_, s_domain, s_host) = _levels(known, suffixes, least, most)
    posterior = lambda level, key: level.select(key, ((F.col("bad") + F.col("k") * F.col("p")) / (F.col("n") + F.col("k"))).alias(f"m_{key}"), (F.col("n") + F.col("k")).alias(f"w_{key}"))
    seen = judged.where("host <> ''").select("host").distinct()
    seen = seen.withColumn("domain", url_domain(F.col("host"), suffixes)).withColumn("suffix", url_suffix(F.col("host"), suffixes))
    for level, key in ((hosts, "host"), (domains, "domain"), (tops, "suffix")):
        seen = seen.join(posterior(level, key), key, "left")
    mean = F.coalesce("m_host", "m_domain", "m_suffix", F.lit(rate))
    inherited = F.least(F.lit(s_host), F.coalesce("w_domain", F.least(F.lit(s_domain), F.coalesce("w_suffix", F.lit(weight)))))
    bad_hosts = seen.where(_bound(mean, F.coalesce("w_host", inherited), z) > lift * rate).select("host", F.lit(True).alias("bad_host"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = judged.join(bad_hosts, "host", "left").withColumn("rule", rule)
    own = F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict, own).alias("verdict"))


def filter_sql(pages: str, outcomes: str, rules: Sequence[tuple[str, str]] = RULES, lift: float = 1.25, z: float = 1.645, least: float = 0.5, most: float = 200.0) -> str:
    """The rows of filter_urls() in DuckDB SQL; pages and outcomes are queries."""
    host = rf"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    two = r"array_to_string(string_split(regexp_replace(host, ':\d*$', ''), '.')[-2:], '.')"
    suffix = f"CASE WHEN {two} IN {SUFFIXES!r} THEN {two} ELSE " + r"string_split(regexp_replace(host, ':\d*$', ''), '.')[-1] END"
    domain = f"CASE WHEN {two} IN {SUFFIXES!r} THEN " + r"array_to_string(string_split(regexp_replace(host, ':\d*$', ''), '.')[-3:], '.')" + f" ELSE {two} END"
    order = sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)
    fits = [(k, t, "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*t.split("/", 1))) for k, t in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for _, t, f in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{k}'" for k, _, f in fits) + " END"
    excess, wide = "(sum(n * pow(bad / n - p, 2)) - sum(p * (1 - p)))", "(sum(n * p * (1 - p)) - sum(p * (1 - p)))"
    strength = f"(SELECT CASE WHEN {wide} > 0 AND {excess} > 0 THEN greatest({least}, least({most}, 1 / ({excess} / {wide}) - 1)) ELSE {most} END AS s FROM {{0}})"
    apart = "SELECT c.*, u.n + u.k - c.n AS w, (u.bad + u.k * u.p - c.bad) / (u.n + u.k - c.n) AS p FROM {0} c JOIN {1} u USING ({2})"
    bound = f"greatest(0.0, m - {z} * sqrt(m * (1 - m) / (w + 1)))"
    return f"""
WITH j AS (SELECT page_id, {host} AS host, {path} AS path FROM ({pages})),
o AS (SELECT {host} AS host, bad FROM ({outcomes})),
h0 AS (SELECT host, count(*)::DOUBLE AS n, sum(bad::INT)::DOUBLE AS bad FROM o WHERE host <> '' AND bad IS NOT NULL GROUP BY host),
h1 AS (SELECT *, {domain} AS domain, {suffix} AS suffix FROM h0),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h1 GROUP BY ALL),
t0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY ALL),
a AS (SELECT coalesce(sum(n), 0) + 2 AS n, coalesce(sum(bad), 0) + 1 AS bad FROM t0),
t1 AS (SELECT t0.*, a.n - t0.n AS w, (a.bad - t0.bad) / (a.n - t0.n) AS p FROM t0, a),
t AS (SELECT *, least((SELECT s FROM {strength.format("t1")}), w) AS k FROM t1),
d1 AS ({apart.format("d0", "t", "suffix")}),
d AS (SELECT *, least((SELECT s FROM {strength.format("d1")}), w) AS k FROM d1),
x1 AS ({apart.format("h1", "d", "domain")}),
x AS (SELECT *, least((SELECT s FROM {strength.format("x1")}), w) AS k FROM x1),
seen AS (SELECT host, {domain} AS domain, {suffix} AS suffix FROM (SELECT DISTINCT host FROM j WHERE host <> '')),
b AS (SELECT seen.host,
  CASE WHEN x.n IS NOT NULL THEN (x.bad + x.k * x.p) / (x.n + x.k) WHEN d.n IS NOT NULL THEN (d.bad + d.k * d.p) / (d.n + d.k) WHEN t.n IS NOT NULL THEN (t.bad + t.k * t.p) / (t.n + t.k) ELSE a.bad / a.n END AS m,
  coalesce(x.n + x.k, least((SELECT s FROM {strength.format("x1")}), coalesce(d.n + d.k, least((SELECT s FROM {strength.format("d1")}), coalesce(t.n + t.k, a.n))))) AS w, a.bad / a.n AS rate
  FROM seen CROSS JOIN a LEFT JOIN x ON seen.host = x.host LEFT JOIN d ON seen.domain = d.domain LEFT JOIN t ON seen.suffix = t.suffix)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({verdict}, CASE WHEN host IN (SELECT host FROM b WHERE {bound} > {lift} * rate) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
