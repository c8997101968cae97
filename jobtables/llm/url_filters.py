"""URL filters by link-graph propagation.

Written rules judge the urls they fit.  For every other url the host decides:
the hosts of allowed pages are the seeds of a personalised PageRank along the
links between hosts, the hosts of blocked pages those of a second one against
the links (who links to blocked hosts is distrusted), and a host is blocked
when its share of distrust exceeds its share of trust.

Mass moves in whole units (``UNITS`` per walk, floored on every edge), so sums
do not depend on the order of additions and reruns agree.  A walk's mass is
the sum over rounds of what a round has received; mass at hosts without links
is lost instead of sent back to the seeds, which changes a walk's mass by a
common factor only, and shares are compared.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null or empty html has no links; links of a host
to itself move nothing; repeated rows count as often as they occur; a host
that no walk reaches is allowed; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtables.llm.shared import Scratch, shuffle_partitions

MAX_RULES = 1_000
UNITS = 10**15
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An anchor's absolute (or scheme-relative) target up to the end of its host.
LINK = (r"""(?i)<a[ \t\n\r\f][^>]*?href[ \t\n\r\f]*=[ \t\n\r\f]*["']?[ \t\n\r\f]*"""
        r"""(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<> \t\n\r\f]*)""")


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")),
                       _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null without one.
    Rules of equal length are tried in the order of their text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled into the plan")
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, pages)``: on how many pages one host links to another."""
    targets = F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), F.lit(1)),
        lambda h: F.translate(h, _UPPER, _LOWER)))
    return pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst")) \
        .where("src <> '' AND dst <> '' AND src <> dst") \
        .groupBy("src", "dst").agg(F.count("*").alias("pages"))


def spread(links: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float, rounds: int,
           per_key: int = 10_000) -> DataFrame:
    """``links(walk, src, dst, pages)``, ``seeds(walk, host, n)`` ->
    ``(walk, host, mass)``: personalised PageRank of every walk from its seeds.

    A host with more than ``per_key`` links has them dealt to that many times
    as many keys, and what it received is sent to each of them, so no key holds
    a hub.  Links stay partitioned over the rounds; a round moves the mass only.
    """
    spark = links.sparkSession
    links = scratch.table(links, "links")
    out = links.groupBy("walk", "src").agg(F.sum("pages").alias("all_pages"),
                                           F.ceil(F.count("*") / per_key).cast("int").alias("parts"))
    out = scratch.table(out, "out-links")
    hubs = scratch.table(out.where("parts > 1").select("walk", F.col("src").alias("host"), "parts"),
                         "hubs")
    edges = links.join(out, ["walk", "src"]).select(
        "walk", F.col("src").alias("host"),
        F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), "dst",
        (F.col("pages") / F.col("all_pages")).alias("share"))
    edges = edges.repartition(shuffle_partitions(spark), "walk", "host", "part") \
        .persist(StorageLevel.DISK_ONLY)
    totals = seeds.groupBy("walk").agg(F.sum("n").alias("total"))
    mass = scratch.table(
        seeds.join(F.broadcast(totals), "walk")  # one row per walk
        .select("walk", "host", F.floor(F.col("n") / F.col("total") * F.lit(float(UNITS)))
                .alias("mass")).where("mass > 0"), "round-0")
    received = [mass]
    for i in range(1, rounds + 1):
        dealt = mass.join(hubs, ["walk", "host"], "left").select(
            "walk", "host", "mass",
            F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        moved = F.floor(F.col("mass").cast("double") * F.col("share") * F.lit(damping))
        mass = scratch.table(
            dealt.join(edges, ["walk", "host", "part"])
            .groupBy("walk", F.col("dst").alias("host")).agg(F.sum(moved).alias("mass"))
            .where("mass > 0"), f"round-{i}")
        if mass.first() is None:
            break
        received.append(mass)
    parts = received[0]
    for m in received[1:]:
        parts = parts.unionByName(m)
    result = scratch.table(parts.groupBy("walk", "host").agg(F.sum("mass").alias("mass")), "mass")
    edges.unpersist()
    scratch.drop(links, out, hubs, *received)
    return result


def host_scores(pages: DataFrame, rules: Sequence[Rule], damping: float = 0.85, rounds: int = 40,
                threshold: float = 1.0) -> DataFrame:
    """``(host, trust, distrust, blocked)``: a host's shares of both walks, for
    every host that one of them reaches.  ``blocked``: ``distrust > threshold
    * trust``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host = host_of(F.col("url"))
    judged = pages.select(host.alias("host"), rule_for(host, path_of(F.col("url")), rules)[1]
                          .alias("verdict")).where("verdict IS NOT NULL AND host <> ''")
    seeds = judged.groupBy("verdict", "host").agg(F.count("*").alias("n")).select(
        F.when(F.col("verdict") == ALLOW, "trust").otherwise("distrust").alias("walk"), "host", "n")
    found = scratch.table(host_links(pages), "host-links")
    links = found.select(F.lit("trust").alias("walk"), "src", "dst", "pages").unionByName(
        found.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"),
                     F.col("src").alias("dst"), "pages"))
    mass = spread(links, scratch.table(seeds, "seeds"), scratch, damping, rounds)
    scratch.drop(found)
    total = mass.groupBy("walk").agg(F.sum("mass").alias("total"))
    share = mass.join(F.broadcast(total), "walk").select(  # one row per walk
        "host", "walk", (F.col("mass") / F.col("total")).alias("share"))

    def of(walk: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("share"))), F.lit(0.0))
    return share.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")) \
        .withColumn("blocked", F.col("distrust") > F.lit(threshold) * F.col("trust"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], **params) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``."""
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_for(host, path, rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"),
                        verdict.alias("verdict"))
    blocked = host_scores(pages, rules, **params).where("blocked").select(
        "host", F.lit(BLOCK).alias("spread"))
    return rows.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", "spread", F.lit(ALLOW)).alias("verdict"))


#: The rules of the registered query.
RULES = (Rule("org", "/", ALLOW), Rule("example.org", "/es/", BLOCK),
         Rule("example.org", "/en/1", BLOCK), Rule("com", "/fr/", ALLOW),
         Rule("com", "/de/", BLOCK))

ORACLE_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM (SELECT DISTINCT host, path FROM u)
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path),
r AS (SELECT u.*, fit.rule, fit.rverdict FROM u LEFT JOIN fit USING (host, path)),
l AS (
  SELECT src, dst, count(*) AS pages FROM (
    SELECT DISTINCT page_row, src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM (SELECT row_number() OVER () AS page_row, host AS src, unnest(regexp_extract_all(
            html, '(?i)<a[ \t\n\r\f][^>]*?href[ \t\n\r\f]*=[ \t\n\r\f]*["'']?[ \t\n\r\f]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''<> \t\n\r\f]*)',
            1)) AS dst FROM u))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
e AS (
  SELECT 'trust' AS walk, src, dst, pages FROM l
  UNION ALL SELECT 'distrust', dst, src, pages FROM l),
f AS (
  SELECT walk, src, dst, pages::DOUBLE / sum(pages) OVER (PARTITION BY walk, src) AS share FROM e),
s AS (
  SELECT CASE rverdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS walk, host, count(*) AS n
  FROM r WHERE rverdict IS NOT NULL AND host <> '' GROUP BY 1, 2),
w AS (
  SELECT 0 AS i, walk, host, CAST(floor(n::DOUBLE / sum(n) OVER (PARTITION BY walk) * 1e15) AS BIGINT)
         AS mass FROM s
  UNION ALL
  SELECT w.i + 1, w.walk, f.dst,
         CAST(sum(CAST(floor(w.mass::DOUBLE * f.share * 0.85::DOUBLE) AS BIGINT)) AS BIGINT)
  FROM w JOIN f ON w.walk = f.walk AND w.host = f.src
  WHERE w.i < 40 AND w.mass > 0 GROUP BY w.i, w.walk, f.dst),
m AS (SELECT walk, host, sum(mass) AS mass FROM w GROUP BY walk, host),
p AS (SELECT walk, host, mass::DOUBLE / (sum(mass) OVER (PARTITION BY walk))::DOUBLE AS share FROM m),
b AS (
  SELECT host FROM p GROUP BY host
  HAVING coalesce(sum(share) FILTER (walk = 'distrust'), 0)
       > coalesce(sum(share) FILTER (walk = 'trust'), 0))
SELECT page_id, host, path, rule,
       coalesce(rverdict, CASE WHEN host IN (SELECT host FROM b) THEN 'block' END, 'allow') AS verdict
FROM r
"""
