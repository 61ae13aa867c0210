"""Operator 5: URL filter by rules and by host reputation (empirical Bayes, host -> registered domain -> suffix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_groups, materialize

#: (action, host, path) of the default policy.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels: one of these labels before a country's two letters.
COUNTRY_SUFFIX = r"(?:^|\.)(?:ac|co|com|edu|go|gob|gov|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}$"


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased. Path: from there up to ``? #``. Both empty
    for null and for urls without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its action; of rules of one length the last one listed."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def registered_domain(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the suffix is the last label, or two labels such as ``co.uk``."""
    two = F.substring_index(host, ".", -2)
    known = host.rlike(COUNTRY_SUFFIX)
    domain = F.when(known, F.substring_index(host, ".", -3)).otherwise(two)
    return domain, F.when(known, two).otherwise(F.substring_index(host, ".", -1))


def _concentration(rows: DataFrame, n: str, k: str, mean: float) -> float:
    """Beta concentration by the method of moments, from one row of sums; ``mean`` is the bad rate over all rows."""
    off = F.col(n) * F.pow(F.col(k) / F.col(n) - mean, 2)
    spread = (
        rows.where(F.col(n) > 0).agg((F.sum(off) / F.sum(n)).alias("s"), (F.count("*") / F.sum(n)).alias("g")).first()
    )
    if spread.s is None:
        return 2.0
    var = mean * (1 - mean)
    return min(1000.0, max(2.0, var / max(spread.s - var * spread.g, 1e-6) - 1))


def host_reputation(hosts: DataFrame, z: float = 1.645, usual_z: float = 2.0) -> DataFrame:
    """Posterior of each host's bad rate. ``hosts``: host, n (known outcomes) and k (bad ones), each host once.

    Outcomes are summed by registered domain, then by suffix. Each level's posterior mean is the mean of the beta prior
    of the level below; concentrations come from the data by moments (three rows of sums). Output: host, n,
    bad_mean, bad_lower (mean - z standard deviations, at least 0) and usual: the upper bound (mean +
    usual_z standard deviations, at most 1) of the beta prior that the host would have without its own outcomes, up to which rates are
    those of ordinary hosts under its domain and suffix, however many outcomes a host has. Domains of a suffix and hosts
    of a domain may be many: they are joined by ``join_groups``.
    """
    domain, suffix = registered_domain(F.col("host"))
    hosts = materialize(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(
        F.sum("n").alias("dn"), F.sum("k").alias("dk"), F.count("*").alias("_hosts")
    )
    domains = materialize(domains, "domains")
    suffixes = domains.groupBy("suffix").agg(
        F.sum("dn").alias("sn"), F.sum("dk").alias("sk"), F.count("*").alias("_domains")
    )
    suffixes = materialize(suffixes, "suffixes")
    known, bad = (x or 0 for x in suffixes.agg(F.sum("sn"), F.sum("sk")).first())
    rate = bad / known if known else 0.5
    cs, cd, ch = (_concentration(*x, rate) for x in ((suffixes, "sn", "sk"), (domains, "dn", "dk"), (hosts, "n", "k")))
    start = (bad + 1) / (known + 2)

    def prior(n, k) -> Column:
        """Mean of a host's beta prior, with ``n`` outcomes and ``k`` bad ones left out of its domain and suffix."""
        of_suffix = (F.col("sk") - k + cs * start) / (F.col("sn") - n + cs)
        return (F.col("dk") - k + cd * of_suffix) / (F.col("dn") - n + cd)

    sums = materialize(join_groups(domains, suffixes, "suffix", "_domains", stored=True).drop("suffix"), "sums")
    rated = join_groups(hosts.drop("suffix"), sums, "domain", "_hosts", stored=True)
    zero = F.lit(0)
    m, others = prior(zero, zero), prior(F.col("n"), F.col("k"))
    rated = rated.select("host", "n", "k", m.alias("m"), others.alias("others"))
    a, b = F.col("k") + ch * F.col("m"), F.col("n") - F.col("k") + ch * (1 - F.col("m"))
    rated = rated.select("host", "n", "others", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    usual = F.col("others") + usual_z * F.sqrt(F.col("others") * (1 - F.col("others")) / (ch + 1))
    return rated.select(
        "host", "n", mean.alias("bad_mean"), F.greatest(F.lit(0.0), mean - z * sd).alias("bad_lower"),
        F.least(F.lit(1.0), usual).alias("usual"),
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules=RULES,
    lift: float = 1.0,
    z: float = 1.645,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_mean, bad_lower for every page.

    The longest fitting rule decides; elsewhere a page is blocked when the lower posterior bound of its host's bad
    rate (``z`` = 1.645: 95 %) exceeds ``lift`` times what is usual for hosts of its domain and suffix, the upper bound
    (two standard deviations) of the fitted prior, so when the host is almost surely worse than nearly all its like. ``outcomes``: doc_id, quality, toxic; a page's outcome is that of the document whose
    number is the first number in its path (bad: quality 0 or toxic 1; several rows: bad if any is; rows with
    neither known are ignored). Null and malformed urls share the empty host; pages repeated are judged each; empty
    tables give no rows, and without outcomes nothing is blocked but by rules; other columns are ignored. Only
    built-in functions run, and no host or number that many pages share is gathered in one task.
    """
    host, path = url_host_path(F.col(url_col))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:[^0-9]|$)", 1)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = materialize(rows.withColumn("_doc", F.when(number != "", number.cast("long"))), "urls")
    is_bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    bad = (
        outcomes.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.max(is_bad.cast("int")).alias("bad"))
    )
    pairs = rows.where("_doc IS NOT NULL").groupBy("host", "_doc").agg(F.count("*").alias("times"))
    known = bad.join(pairs.groupBy("_doc").agg(F.count("*").alias("_n")), "_doc")
    labelled = join_groups(pairs, known, "_doc", "_n")
    counts = labelled.groupBy("host").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("bad")).alias("k"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("_n"))
    zero = F.lit(0).cast("long")
    hosts = materialize(
        hosts.join(counts, "host", "left").select(
            "host", "_n", F.coalesce("n", zero).alias("n"), F.coalesce("k", zero).alias("k")
        ),
        "outcomes",
    )
    rated = host_reputation(hosts.drop("_n"), z).drop("n").join(hosts.select("host", "_n"), "host")
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("bad_lower") > lift * F.col("usual"), F.lit("block")).otherwise("allow"))
    judged = join_groups(rows, rated, "host", "_n")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_mean", "bad_lower"
    )


#: The same in DuckDB, for the digest columns.
ORACLE_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substring(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
o AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM q LEFT JOIN o ON o.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:[^0-9]|$)', 1) AS BIGINT) GROUP BY host),
hl AS (SELECT *, string_split(host, '.') AS l, CASE WHEN regexp_matches(host, '(?:^|\.)(?:ac|co|com|edu|go|gob|gov|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}$') THEN 2 ELSE 1 END AS two FROM h),
hd AS (SELECT host, n, k, array_to_string(list_slice(l, greatest(1, len(l) - two), len(l)), '.') AS domain, array_to_string(list_slice(l, greatest(1, len(l) - two + 1), len(l)), '.') AS suffix FROM hl),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM hd GROUP BY ALL),
s AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM d GROUP BY ALL),
g AS (SELECT (sum(sk) + 1.0) / (sum(sn) + 2.0) AS g, sum(sk) * 1.0 / sum(sn) AS m FROM s),
cs AS (SELECT least(1000.0, greatest(2.0, m * (1 - m) / greatest(sum(sn * pow(sk * 1.0 / sn - m, 2)) / sum(sn) - m * (1 - m) * count(*) / sum(sn), 1e-6) - 1)) AS c FROM s, g WHERE sn > 0 GROUP BY m),
cd AS (SELECT least(1000.0, greatest(2.0, m * (1 - m) / greatest(sum(dn * pow(dk * 1.0 / dn - m, 2)) / sum(dn) - m * (1 - m) * count(*) / sum(dn), 1e-6) - 1)) AS c FROM d, g WHERE dn > 0 GROUP BY m),
ch AS (SELECT least(1000.0, greatest(2.0, m * (1 - m) / greatest(sum(n * pow(k * 1.0 / n - m, 2)) / sum(n) - m * (1 - m) * count(*) / sum(n), 1e-6) - 1)) AS c FROM h, g WHERE n > 0 GROUP BY m),
hs AS (SELECT host, n, k, dn, dk, sn, sk, cs.c AS cs, cd.c AS cd, ch.c AS ch, g FROM hd JOIN d USING (domain) JOIN s ON s.suffix = d.suffix, cs, cd, ch, g),
pr AS (SELECT *, (dk + cd * (sk + cs * g) / (sn + cs)) / (dn + cd) AS m, (dk - k + cd * (sk - k + cs * g) / (sn - n + cs)) / (dn - n + cd) AS o FROM hs),
ab AS (SELECT host, o, ch, k + ch * m AS a, n - k + ch * (1 - m) AS b FROM pr),
v AS (SELECT host, greatest(0, a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1)))) > least(1, o + 2 * sqrt(o * (1 - o) / (ch + 1))) AS bad FROM ab),
r AS (SELECT q.*, v.bad, host = 'net' OR host LIKE '%.net' AS is_net, host = 'com' OR host LIKE '%.com' AS is_com,
  host = 'example.com' OR host LIKE '%.example.com' AS is_ex, host = 'www.example.com' OR host LIKE '%.www.example.com' AS is_www FROM q LEFT JOIN v USING (host)),
t AS (SELECT *, CASE WHEN is_www AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN is_ex AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN is_net AND path LIKE '/es/%' THEN 'net/es/' WHEN is_net AND path LIKE '/fr/%' THEN 'net/fr/' WHEN is_com AND path LIKE '/%' THEN 'com/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM t
"""
