"""URL filters: rules first, then trust and distrust spread over the links between hosts.

A page that a rule fits gets the longest rule's verdict.  For the others the
host decides.  Hosts with pages that rules allow are trusted seeds, hosts most
of whose pages rules block are blocked seeds.  Personalised PageRank carries
trust from the seeds along the links, and distrust against them, to the hosts
that link to blocked ones.  To compare the two, each is taken times the sum of
its seeds, so that a host's verdict depends on its neighbourhood and not on how
many seeds there are elsewhere; a host is blocked if its distrust is above its
trust by more than the threshold's share of both.  DataFrame functions alone.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from quillon.staging import stage


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path; the host's subdomains and longer paths are meant too."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


# The rules of the query.
RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))
#: Share of a host's score that goes on over its links.
DAMPING = 0.85
#: How far distrust must be above trust, as a share of both, and the share of blocked pages above which a host is a blocked seed.
THRESHOLD, SEED_SHARE = 1e-9, 0.5
#: Rounds after which lineage is cut.
CUT = 4
#: Share of a score by which it may still grow when spreading ends; as each round passes on DAMPING of the last, what is left is about the threshold.
TOLERANCE = THRESHOLD * (1 - DAMPING) / DAMPING

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text of the longest rule that fits, else null; equal lengths by code point."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def host_links(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(source, target, n): links between different hosts, counted."""
    found = F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(_LINK), F.lit(1))
    links = pages.select(host.alias("source"), F.explode(found).alias("target")).select("source", _lower(F.col("target")).alias("target"))
    return links.where("source <> '' and source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from ``links`` (source, target, n) and ``seeds`` (host, trust, distrust).

    With ``rounds`` None it ends once no score has grown by more than
    ``tolerance`` of itself and no new host was reached.

    Seeds are scaled to add up to 1.  Trust is shared out by a host's links,
    distrust by the links to it; what reaches a host without any is lost.
    """
    sums = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
    start = seeds.crossJoin(F.broadcast(sums)).select(  # one row of sums
        "host",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.when(F.col("t") > 0, F.col("trust") / F.col("t")).otherwise(0.0).alias("seed")),
                F.struct(F.lit(1).alias("kind"), F.when(F.col("d") > 0, F.col("distrust") / F.col("d")).otherwise(0.0).alias("seed")),
            )
        ).alias("s"),
    )
    start = stage(start.select("host", "s.kind", "s.seed").where("seed > 0"), "seeds")
    along = links.select(F.lit(0).alias("kind"), F.col("source").alias("giver"), F.col("target").alias("taker"), "n")
    against = links.select(F.lit(1).alias("kind"), F.col("target").alias("giver"), F.col("source").alias("taker"), "n")
    ways = stage(along.unionByName(against), "ways")
    given = ways.groupBy("kind", "giver").agg(F.sum("n").alias("given"))
    ways = stage(ways.join(given, ["kind", "giver"]).select("kind", "giver", "taker", (F.col("n") / F.col("given")).alias("part")), "ways")
    base = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    scores = settled = base
    for done in (count(1) if rounds is None else range(1, rounds + 1)) if ways.limit(1).count() else ():
        moved = ways.join(scores, (ways.kind == scores.kind) & (ways.giver == scores.host)).select(
            ways.kind, F.col("taker").alias("host"), (F.col("part") * F.col("score") * damping).alias("score")
        )
        scores = base.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if done % CUT == 0:
            scores = stage(scores, "scores")
            if rounds is None:  # scores never fall, so growth over several rounds bounds that of the last
                grown = scores.join(settled.withColumnRenamed("score", "was"), ["kind", "host"], "left")
                if not grown.where(F.col("score") - F.coalesce("was", F.lit(0.0)) > tolerance * F.col("score")).limit(1).count():
                    break
                settled = scores
    by_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(by_kind(0).alias("trust"), by_kind(1).alias("distrust"))


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: page_id, host, path, rule (null if none fits), verdict (allow or block), trust and distrust of the host.

    Without a rule a host of no evidence is allowed, and so are urls without a
    host.  Null html has no links; a link to the page's own host, and one
    without a host, is none.  Repeated rows get equal rows (and their links
    count again), null ids stay null, other columns are ignored, and an empty
    table gives an empty table.
    """
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    ruled = parsed.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    verdict_of = F.create_map(*(F.lit(x) for r in rules for x in (r.text, r.verdict))) if rules else None
    by_rule = F.element_at(verdict_of, F.col("rule")) if rules else F.lit(None).cast("string")
    ruled = ruled.withColumn("by_rule", F.when(F.col("rule").isNotNull(), by_rule))
    shares = ruled.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("by_rule") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0)).alias("distrust"),
    )
    seeds = shares.select("host", "trust", F.when(F.col("distrust") > SEED_SHARE, F.col("distrust")).otherwise(0.0).alias("distrust"))
    hosts = spread(host_links(pages, url_host(url), html_col), seeds)
    scored = ruled.join(hosts, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    sums = seeds.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"all_{c}") for c in ("trust", "distrust")))
    scored = scored.crossJoin(F.broadcast(sums))  # one row of sums
    good, bad = F.col("trust") * F.col("all_trust"), F.col("distrust") * F.col("all_distrust")
    by_host = F.when(bad - good > threshold * (bad + good), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust")


def oracle() -> str:
    """The same in DuckDB SQL, for the default rules; trust and distrust rounded to 9 places as in the query.

    Each round of the recursion passes on what the last one moved, until what is moved is below 1e-18 everywhere.
    """
    return f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT page_id, host, path, html, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed),
judged AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS by_rule FROM ruled),
shares AS (
  SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust, avg(CASE WHEN by_rule = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust
  FROM judged WHERE host <> '' GROUP BY host),
seeds AS (SELECT host, trust, CASE WHEN distrust > {SEED_SHARE} THEN distrust ELSE 0 END AS distrust FROM shares),
links AS (
  SELECT source, target, count(*) AS n FROM (
    SELECT host AS source, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?(?:https?:)?//([^/?#"''\\s>]+)', 1)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS target
    FROM parsed)
  WHERE source <> '' AND source <> target GROUP BY source, target),
directed AS (
  SELECT 0 AS kind, source AS giver, target AS taker, n FROM links
  UNION ALL SELECT 1, target, source, n FROM links),
ways AS (SELECT kind, giver, taker, n / sum(n) OVER (PARTITION BY kind, giver)::DOUBLE AS part FROM directed),
r0 AS (
  SELECT 0 AS kind, host, trust / (SELECT sum(trust) FROM seeds) * {1 - DAMPING} AS score FROM seeds WHERE trust > 0
  UNION ALL SELECT 1, host, distrust / (SELECT sum(distrust) FROM seeds) * {1 - DAMPING} FROM seeds WHERE distrust > 0),
moved AS (
  SELECT kind, host, score FROM r0
  UNION ALL
  SELECT w.kind, w.taker, sum(w.part * m.score * {DAMPING}) FROM ways w JOIN moved m ON w.kind = m.kind AND w.giver = m.host GROUP BY w.kind, w.taker HAVING sum(w.part * m.score) > 1e-18),
hosts AS (
  SELECT host, coalesce(sum(score) FILTER (kind = 0), 0) AS trust, coalesce(sum(score) FILTER (kind = 1), 0) AS distrust FROM moved GROUP BY host),
compared AS (
  SELECT host, trust, distrust, trust * (SELECT coalesce(sum(trust), 0) FROM seeds) AS good, distrust * (SELECT coalesce(sum(distrust), 0) FROM seeds) AS bad FROM hosts)
SELECT page_id, j.host, path, rule,
       coalesce(by_rule, CASE WHEN coalesce(bad - good > {THRESHOLD} * (bad + good), false) THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(h.trust, 0), 9) AS trust, round(coalesce(h.distrust, 0), 9) AS distrust
FROM judged j LEFT JOIN compared h ON j.host = h.host
"""
