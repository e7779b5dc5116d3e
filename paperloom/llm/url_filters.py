"""URL filters: fixed host and path rules, then empirical-Bayes host reputation.

Labelled page outcomes are shrunk through beta-binomial priors: a suffix towards the whole
corpus, a registered domain towards its suffix, a host towards its domain. The strength of each
prior is estimated from how much the groups of its level differ (the intraclass correlation),
so levels whose groups are alike share more. A page without a fitting rule is blocked if its
host's posterior bad rate lies above the limit with the given certainty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

# The rules.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Labels under which names are registered before a country's two letters, as co.uk and com.hk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Hosts whose posteriors are broadcast at most (under 100 bytes each); beyond, the join is salted.
BROADCAST_HOSTS, SALT = 200_000, 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def _two_labels(second_level: tuple[str, ...]) -> str:
    return rf"(^|\.)({'|'.join(second_level)})\.[a-z][a-z]$"


def _parts(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column]:
    """Registered domain and suffix. A port does not count; an IPv4 address is its own domain."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    two = bare.rlike(_two_labels(second_level))
    labels = F.split(bare, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), ".")
    domain = F.when(address, bare).when(two, last(3)).otherwise(last(2))
    suffix = F.when(address, F.lit("")).when(two, last(2)).otherwise(last(1))
    return domain, suffix


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits. The rules become one CASE."""
    rule = verdict = None
    for text, decision in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the prior's weight in pages, from the intraclass correlation of the groups' bad
    rates (kept within 0.001 and 0.999; 1 where there is nothing to estimate from)."""
    sums = groups.filter("n > 0").agg(
        F.sum("n").alias("total"), F.sum("k").alias("bad"), F.count("*").alias("groups"),
        F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("between"),
    )
    p = F.col("bad") / F.col("total")
    spread = (F.col("between") - F.col("bad") * p) / F.nullif(p * (1 - p), F.lit(0.0)) - (F.col("groups") - 1)
    room = F.nullif(F.col("total") - F.col("squares") / F.col("total") - (F.col("groups") - 1), F.lit(0.0))
    rho = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.coalesce(spread / room, F.lit(0.5))))
    return sums.select((1 / rho - 1).alias(name))


def host_reputation(pages: DataFrame, outcomes: DataFrame, certainty: float = 1.645, second_level: tuple[str, ...] = SECOND_LEVEL) -> DataFrame:
    """Posterior of each host: host, n, k (labelled and bad pages), mean, bound.

    pages has (page_id, host), outcomes has (page_id, bad 0/1, null where unknown; one row a
    page). bound is mean - certainty * standard deviation of the beta posterior. Counts are
    pre-aggregated by host, and by domain and suffix from those, so no page-sized group meets in
    one task; only the three one-row prior strengths are broadcast.
    """
    hosts = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = _parts(F.col("host"), second_level)
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")  # read five times
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    strengths = _strength(hosts, "m_host").crossJoin(_strength(domains, "m_domain")).crossJoin(_strength(suffixes, "m_suffix")).crossJoin(suffixes.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k")))
    top = F.coalesce(F.col("all_k") / F.nullif("all_n", F.lit(0)), F.lit(0.5))
    suffixes = suffixes.crossJoin(F.broadcast(strengths)).select("suffix", "m_host", "m_domain", ((F.col("k") + F.col("m_suffix") * top) / (F.col("n") + F.col("m_suffix"))).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", "m_host", ((F.col("k") + F.col("m_domain") * F.col("suffix_mean")) / (F.col("n") + F.col("m_domain"))).alias("domain_mean"))
    a, b = F.col("k") + F.col("m_host") * F.col("domain_mean"), F.col("n") - F.col("k") + F.col("m_host") * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    return hosts.join(domains, ["domain", "suffix"]).select("host", "n", "k", F.round(mean, 9).alias("mean"), F.round(mean - certainty * F.sqrt(mean * (1 - mean) / (a + b + 1)), 9).alias("bound"))


def url_filters(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, limit: float = 0.2, certainty: float = 1.645, second_level: tuple[str, ...] = SECOND_LEVEL, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Return page_id, host, path, rule, verdict ('allow' or 'block'), bad_mean and bad_bound.

    outcomes: (page_id, bad). Null url, or one without '://': host and path are empty, and such
    pages share the reputation of the empty host. Null ids have no outcome. Repeated pages each
    count and are judged alike; empty tables give an empty result; without outcomes every host
    has the prior mean 0.5 and a bound under any sensible limit; very long urls are judged whole;
    other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.select("page_id", F.col("bad").cast("long").alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    posterior = host_reputation(rows.select("page_id", "host"), known, certainty, second_level).select("host", F.col("mean").alias("bad_mean"), F.col("bound").alias("bad_bound"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    posterior = stored(posterior, "posterior")
    if posterior.count() <= BROADCAST_HOSTS:
        judged = rows.join(F.broadcast(posterior), "host")
    else:  # a host that holds a third of all pages is dealt to SALT tasks
        salted = posterior.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        judged = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"])
    return judged.select(F.col("page_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_bound") > limit, "block").otherwise("allow")).alias("verdict"), "bad_mean", "bad_bound")


def oracle(limit: float = 0.2, certainty: float = 1.645) -> str:
    """The same result in DuckDB SQL, over pages and labels."""
    cases = {"rule": [], "verdict": []}
    for text, decision in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN "
        cases["rule"].append(f"{fits}'{text}'")
        cases["verdict"].append(f"{fits}'{decision}'")

    def strength(groups: str) -> str:
        return f"""(SELECT 1 / least(0.999, greatest(0.001, coalesce(
            ((between_sum - bad * (bad / total)) / nullif((bad / total) * (1 - bad / total), 0.0) - (groups - 1))
            / nullif(total - squares / total - (groups - 1), 0.0), 0.5))) - 1 AS m
          FROM (SELECT sum(n)::DOUBLE AS total, sum(k)::DOUBLE AS bad, count(*) AS groups, sum(n * n)::DOUBLE AS squares,
                       sum(k::DOUBLE * k / n) AS between_sum FROM {groups} WHERE n > 0))"""

    return rf"""
WITH rows AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
known AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
counted AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM rows LEFT JOIN known USING (page_id) GROUP BY host),
bare AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM counted),
split AS (
  SELECT *, string_split(name, '.') AS parts, regexp_matches(name, '^[0-9]+(\.[0-9]+){{3}}$') AS address,
         regexp_matches(name, '{_two_labels(SECOND_LEVEL)}') AS two FROM bare),
hosts AS (
  SELECT host, n, k,
         CASE WHEN address THEN name WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
         CASE WHEN address THEN '' WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix
  FROM split),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL),
strengths AS (
  SELECT h.m AS m_host, d.m AS m_domain, s.m AS m_suffix, coalesce(t.k / nullif(t.n, 0), 0.5) AS top
  FROM {strength("hosts")} h, {strength("domains")} d, {strength("suffixes")} s,
       (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM suffixes) t),
suffix_means AS (SELECT suffix, m_host, m_domain, (k + m_suffix * top) / (n + m_suffix) AS suffix_mean FROM suffixes, strengths),
domain_means AS (
  SELECT domain, suffix, m_host, (k + m_domain * suffix_mean) / (n + m_domain) AS domain_mean
  FROM domains JOIN suffix_means USING (suffix)),
posterior AS (
  SELECT host, a / (a + b) AS mean, a + b AS weight
  FROM (SELECT host, k + m_host * domain_mean AS a, n - k + m_host * (1 - domain_mean) AS b
        FROM hosts JOIN domain_means USING (domain, suffix)) x),
bounds AS (
  SELECT host, round(mean, 9) AS bad_mean, round(mean - {certainty} * sqrt(mean * (1 - mean) / (weight + 1)), 9) AS bad_bound FROM posterior)
SELECT page_id, host, path, CASE {" ".join(cases["rule"])} END AS rule,
       coalesce(CASE {" ".join(cases["verdict"])} END, CASE WHEN bad_bound > {limit} THEN 'block' ELSE 'allow' END) AS verdict,
       bad_mean, bad_bound
FROM rows JOIN bounds USING (host)"""
