"""Allow and block rules for addresses, and trust that spreads over the host graph where no rule fits.

Hosts whose pages are allowed by rule are trusted seeds, hosts whose pages are blocked are distrusted ones.
Trust follows links (personalised PageRank), distrust follows them backwards; a host with more distrust than
trust is blocked.

Nulls and odd rows: a null address or one without ``://`` has an empty host and path, fits no rule and is
allowed; null html has no links; links to the own host don't count; repeated rows count each time and get the
same answer; an empty table gives an empty result; other columns are not read.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperloom.staging import discard, stage

#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules are part of the plan; longer lists belong in seeds.
MOST_RULES = 500
FOLLOW, MARGIN = 0.85, 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""[hH][rR][eE][fF][ \t\r\n]*=[ \t\r\n]*["']?[ \t\r\n]*([^"'> \t\r\n]*)"""
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, of, start = rule
    return ((host == of) | host.endswith("." + of)) & path.startswith(start)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule as host and path, verdict)`` of the longest rule that fits; null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    pick = lambda value: reduce(lambda rest, r: F.when(fits(host, path, r), value(r)).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))
    return pick(lambda r: F.lit(r[1] + r[2])), pick(lambda r: F.lit(r[0]))


def host_edges(pages: DataFrame) -> DataFrame:
    """``s, t, n``: links from one host to another in ``pages(host, html)``."""
    link = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    return link.where(F.col("link").rlike(ABSOLUTE)).select(F.col("host").alias("s"), host_of(target).alias("t")).where("s <> t and t <> ''").groupBy("s", "t").agg(F.count("*").alias("n"))


def spread(hosts: DataFrame, edges: DataFrame, follow: float = FOLLOW, rounds: int | None = None, margin: float = MARGIN) -> DataFrame:
    """``host, trust, distrust`` from ``hosts(host, good, bad)``. What a host without links would pass on is lost.

    All changes of a round together shrink by ``follow`` from round to round, so those of all further rounds are known to stay
    below a sum; it ends when this is a tenth of ``margin``, or after ``rounds``.
    """
    edges = edges.join(edges.groupBy("s").agg(F.sum("n").alias("outs")), "s").join(edges.groupBy("t").agg(F.sum("n").alias("ins")), "t")
    edges = stage(edges.select("s", "t", (F.col("n") / F.col("outs")).alias("forth"), (F.col("n") / F.col("ins")).alias("back")), "edges")
    named = edges.select(F.col("s").alias("host")).unionByName(edges.select(F.col("t").alias("host"))).distinct()
    hosts = stage(hosts.join(named, "host", "full").select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")), "hosts")
    now, number = stage(hosts.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust")), "trust"), 0
    while rounds is None or number < rounds:
        good = edges.join(now, edges["s"] == now["host"]).select(F.col("t").alias("host"), (F.col("trust") * F.col("forth")).alias("g"), F.lit(0.0).alias("b"))
        bad = edges.join(now, edges["t"] == now["host"]).select(F.col("s").alias("host"), F.lit(0.0).alias("g"), (F.col("distrust") * F.col("back")).alias("b"))
        got = good.unionByName(bad).groupBy("host").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
        step = lambda seed, flow: (1 - follow) * F.col(seed) + follow * F.coalesce(flow, F.lit(0.0))
        before = now.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        after = hosts.join(got, "host", "left").join(before, "host").select("host", step("good", "g").alias("trust"), step("bad", "b").alias("distrust"), "t0", "d0")
        after = stage(after, "trust")
        moved = after.agg(F.sum(F.abs(F.col("trust") - F.col("t0"))), F.sum(F.abs(F.col("distrust") - F.col("d0")))).first()
        discard(now)
        now, number = after, number + 1
        if max(moved[0] or 0.0, moved[1] or 0.0) * follow / (1 - follow) <= margin / 10:
            break
    return now.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, follow: float = FOLLOW) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages(page_id, url, html)``."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    share = lambda kind: F.avg(F.when(F.col("by_rule") == kind, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    scores = spread(seeds, host_edges(parts.select("host", "html")), follow)
    blocked = scores.where(F.col("distrust") - F.col("trust") > MARGIN).select("host", F.lit("block").alias("by_host"))
    return ruled.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))


#: Rounds of the statement in SQL, which can't see when nothing moves.
SQL_ROUNDS = 200


def judge_sql() -> str:
    """The same in one SQL statement over ``pages``."""
    host = lambda u: f"translate(regexp_extract(CASE WHEN contains({u}, '://') THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END, '^[^/?#]*', 0), '{UPPER}', '{LOWER}')"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, coalesce({host('url')}, '') AS host,
    coalesce(regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, of, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT host AS h0, path AS p0, arg_max(of || start, length(of || start)) AS rule, arg_max(verdict, length(of || start)) AS by_rule
      FROM (SELECT DISTINCT host, path FROM p), rules WHERE (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY host, path),
j AS (SELECT page_id, host, path, rule, by_rule FROM p LEFT JOIN f ON host = h0 AND path = p0),
l AS (SELECT host AS s, unnest(regexp_extract_all(html, '[hH][rR][eE][fF][ \\t\\r\\n]*=[ \\t\\r\\n]*["'']?[ \\t\\r\\n]*([^"''> \\t\\r\\n]*)', 1)) AS link FROM p WHERE host <> ''),
n AS (SELECT s, {host('u')} AS t FROM (SELECT s, CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END AS u FROM l
      WHERE regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:)?//'))),
c AS (SELECT s, t, count(*) AS n FROM n WHERE s <> t AND t <> '' GROUP BY s, t),
e AS MATERIALIZED (SELECT s, t, n / sum(n) OVER (PARTITION BY s) AS forth, n / sum(n) OVER (PARTITION BY t) AS back FROM c),
h AS MATERIALIZED (SELECT host, max(good) AS good, max(bad) AS bad FROM (
      SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good, avg(CASE WHEN by_rule = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS bad FROM j WHERE host <> '' GROUP BY host
      UNION ALL SELECT s, 0, 0 FROM e UNION ALL SELECT t, 0, 0 FROM e) GROUP BY host),
r(k, host, trust, distrust) AS (
  SELECT 0, host, good, bad FROM h
  UNION ALL
  SELECT k + 1, h.host, 0.15::DOUBLE * good + 0.85::DOUBLE * coalesce(g, 0), 0.15::DOUBLE * bad + 0.85::DOUBLE * coalesce(b, 0)
  FROM (SELECT max(k) AS k FROM r) now, h
  LEFT JOIN (SELECT t AS host, sum(trust * forth) AS g FROM e JOIN r ON s = host GROUP BY t) x ON h.host = x.host
  LEFT JOIN (SELECT s AS host, sum(distrust * back) AS b FROM e JOIN r ON t = host GROUP BY s) y ON h.host = y.host
  WHERE k < {SQL_ROUNDS})
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN distrust - trust > 1e-9 THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN (SELECT * FROM r WHERE k = {SQL_ROUNDS}) r ON j.host = r.host"""
