"""URL filters: explicit rules, then empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. Each
level's rate of bad pages is shrunk towards the level above it by a
beta-binomial prior whose strength is fitted by moments to how far the level's
rates differ. A host is blocked when the lower bound of its posterior rate
passes a threshold, so a host with few outcomes goes with its domain, and a
domain with few with its suffix.

Counts are partial sums per task before any row moves, so a host that holds
most pages costs one row a task. The table of judged hosts is stored; Spark
sees its size and broadcasts it only if it is below the session's threshold,
else it joins by host and splits what is skewed.

Defined results: a null url, or one without ``://``, has an empty host and
path and no rule; it is judged like any host without outcomes. Null or repeated
ids are rows like any other, and repeated rows have equal verdicts; of rules that
fit, the longest wins, and no two have one length; outcomes that are null count
for nothing; urls of any length are read whole; columns of any other name play
no part; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, rule): a rule is a host, which covers its subdomains, and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Second-level names under which a two-letter suffix registers domains, as in co.uk.
SHARED_SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A-Z lower-cased, and the path of a url; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, ascii_uppercase, ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null; of two rules alike in length the first in order."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The registered domain (two labels, or three under a shared second level) and the last label."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = F.element_at(labels, -1)
    deep = (n >= 3) & (F.length(suffix) == 2) & F.get(labels, n - 2).isin(*SHARED_SECOND_LEVEL)
    domain = F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return domain, suffix


def _strength(groups: DataFrame, parent_rate: Column) -> DataFrame:
    """The fitted prior strength of one level: moments of the beta-binomial, within 1 and 10,000; one row.

    With n outcomes in a group, k of them bad, and rate m above it, the squared
    difference of k / n and m has mean m (1 - m) (1 + (n - 1) r) / n, where
    strength is 1 / r - 1.
    """
    m, n = parent_rate, F.col("n").cast("double")
    spread = m * (1 - m)
    excess = F.sum(n * (F.col("k") / n - m) * (F.col("k") / n - m) - spread)
    room = F.sum(spread * (n - 1))
    r = F.when(room > 0, excess / room).otherwise(F.lit(0.0))
    bounded = F.least(F.greatest(r, F.lit(1e-4)), F.lit(0.5))
    return groups.filter(n > 0).agg(F.coalesce(1 / bounded - 1, F.lit(1.0)).alias("strength"))


def reputation(outcomes: DataFrame, z: float = 1.645, at_most: float = 0.5) -> DataFrame:
    """Judged hosts from outcomes (host, bad): host, rate, bound, blocked; one row a host with outcomes.

    `bound` is the posterior mean less `z` posterior deviations; a host is
    blocked when it passes `at_most`.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = stored(
        outcomes.filter(F.col("bad").isNotNull() & F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
        .withColumn("domain", domain)
        .withColumn("suffix", suffix)
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    everything = suffixes.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("above"))

    def shrunk(level: DataFrame) -> DataFrame:
        """Adds `prior`, `rate` and `weight` to rows that hold n, k and `above`, the rate of the level above."""
        fitted = level.crossJoin(F.broadcast(_strength(level, F.col("above"))))  # one row by construction
        return (
            fitted.withColumn("prior", F.col("strength") * F.col("above"))
            .withColumn("weight", F.col("n") + F.col("strength"))
            .withColumn("rate", (F.col("k") + F.col("prior")) / F.col("weight"))
        )

    suffixes = shrunk(suffixes.crossJoin(F.broadcast(everything))).select("suffix", F.col("rate").alias("above"))
    domains = shrunk(domains.join(suffixes, "suffix")).select("domain", F.col("rate").alias("above"))
    judged = shrunk(hosts.join(domains, "domain"))
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return stored(judged.select("host", "rate", bound.alias("bound")).withColumn("blocked", F.col("bound") > at_most))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, z: float = 1.645, at_most: float = 0.5) -> DataFrame:
    """A verdict for each row of `pages`: the id, host, path, rule, verdict and rate (null where a host has no outcomes).

    `outcomes` holds (url, bad): a labelled page and whether it was bad.
    """
    host, path = host_and_path(F.col("url"))
    judged = reputation(outcomes.select("url", "bad").select(host.alias("host"), "bad"), z, at_most).select(F.col("host").alias("judged_host"), "rate", "blocked")
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.coalesce(F.col("blocked"), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(judged, F.col("host") == F.col("judged_host"), "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), method).alias("verdict"), "rate"
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes (url, bad) of pages that show a labelled document: its number is the last in the path."""
    _, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})[^0-9/]*/?$", 1)
    shown = pages.select("url", number.try_cast("bigint").alias("doc"))
    marked = labels.groupBy(F.col("doc_id").alias("doc")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return shown.filter(F.col("doc").isNotNull()).join(marked, "doc").select("url", "bad")


ORACLE = r"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parsed as (
  select page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') as raw, coalesce(rest, '') as rest from cut),
p as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from parsed),
marked as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is null or toxic is null then null else 0 end) as bad from labels group by doc_id),
outcomes as (
  select p.host, m.bad from p join marked m
  on m.doc_id = try_cast(regexp_extract(p.path, '/([0-9]{1,18})[^0-9/]*/?$', 1) as bigint) where m.bad is not null),
hosts as (select host, count(*) as n, sum(bad) as k from outcomes group by host),
named as (
  select *, string_split(host, '.') as l from hosts),
h as (
  select host, n, k, l[-1] as suffix,
         array_to_string(l[greatest(1, len(l) - case when len(l) >= 3 and length(l[-1]) = 2 and l[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') then 2 else 1 end):], '.') as domain
  from named),
d as (select domain, suffix, sum(n) as n, sum(k) as k from h group by domain, suffix),
s as (select suffix, sum(n) as n, sum(k) as k from d group by suffix),
g as (select (sum(k) + 0.5) / (sum(n) + 1) as m from s),
ss as (select suffix, n, k, m from s, g),
fs as (select 1 / least(greatest(case when sum(m * (1 - m) * (n - 1)) > 0 then sum(n * (k / n - m) * (k / n - m) - m * (1 - m)) / sum(m * (1 - m) * (n - 1)) else 0 end, 1e-4), 0.5) - 1 as strength from ss),
rs as (select suffix, (k + strength * m) / (n + strength) as m from ss, fs),
dd as (select domain, n, k, m from d join rs using (suffix)),
fd as (select 1 / least(greatest(case when sum(m * (1 - m) * (n - 1)) > 0 then sum(n * (k / n - m) * (k / n - m) - m * (1 - m)) / sum(m * (1 - m) * (n - 1)) else 0 end, 1e-4), 0.5) - 1 as strength from dd),
rd as (select domain, (k + strength * m) / (n + strength) as m from dd, fd),
hh as (select host, n, k, m from h join rd using (domain)),
fh as (select 1 / least(greatest(case when sum(m * (1 - m) * (n - 1)) > 0 then sum(n * (k / n - m) * (k / n - m) - m * (1 - m)) / sum(m * (1 - m) * (n - 1)) else 0 end, 1e-4), 0.5) - 1 as strength from hh),
rh as (select host, n + strength as w, (k + strength * m) / (n + strength) as rate from hh, fh),
judged as (select host, rate, rate - 1.645 * sqrt(rate * (1 - rate) / (w + 1)) > 0.5 as blocked from rh),
r as (
  select page_id, host, path,
    case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from p)
select page_id, host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule in ('example.com/de/', 'net/') then 'block'
       when coalesce(blocked, false) then 'block' else 'allow' end as verdict,
  round(rate, 9) as rate
from r left join judged using (host)
"""
