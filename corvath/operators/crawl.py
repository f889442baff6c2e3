"""Crawling as tables: the frontier by levels, robots rules, a simulated crawl over given pages."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvath.functions.urls import canonical_url, domain_allowed, domain_keys, normalize_domain, url_domain
from corvath.session import cut_lineage
from corvath.sources.parse import html_links


def allowed(urls: DataFrame, domains: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows whose URL's host an enabled entry of the allowlist allows.

    Plain entries meet by equality on the host, its parents and its www twin. An entry with a wildcard meets by what
    follows its last wildcard, if that begins with a dot (*.x.org), and is then matched in full; what is left (a wildcard
    at the end) meets every host, of which there are far fewer than URLs.
    """
    patterns = domains.where("enabled").select(normalize_domain(F.col("domain")).alias("pattern")).where("pattern <> ''").distinct()
    host = url_domain(F.col(url_col))
    hosts = cut_lineage(urls.select(host.alias("own_host")).where("own_host is not null").distinct())
    plain = patterns.where(~F.col("pattern").contains("*"))
    good = hosts.select("own_host", F.explode(domain_keys(F.col("own_host"))).alias("pattern")).join(plain, "pattern").select("own_host")
    wild = patterns.where(F.col("pattern").contains("*")).withColumn("key", F.nullif(F.regexp_extract("pattern", "\\*\\.([^*]*)$", 1), F.lit("")))
    by_key = hosts.select("own_host", F.explode(domain_keys(F.col("own_host"))).alias("key")).join(wild.where("key is not null"), "key").where(domain_allowed(F.col("own_host"), F.col("pattern"))).select("own_host")
    # one array of them: matched within the host's row
    rest = wild.where("key is null").agg(F.collect_set("pattern").alias("rest")).first()["rest"]
    by_rest = hosts.where(F.exists(F.array(*map(F.lit, sorted(rest))), lambda p: domain_allowed(F.col("own_host"), p))) if rest else hosts.limit(0)
    listed = good.unionByName(by_key).unionByName(by_rest).distinct()
    return urls.withColumn("own_host", host).join(listed, "own_host", "left_semi").select(*urls.columns)


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """urls with robots_ok and crawl_delay. robots: domain, status, body.

    200 is parsed, 401 and 403 forbid everything, anything else and no robots file allow everything; a URL must be open
    to the agent and to `*`.
    """

    @F.pandas_udf("struct<ok: boolean, delay: double>")
    def judge(url: pd.Series, status: pd.Series, body: pd.Series) -> pd.DataFrame:
        known: dict[str, RobotFileParser] = {}
        out = []
        for u, s, b in zip(url, status, body):
            if pd.isna(s) or s not in (200, 401, 403):
                out.append((True, None))
            elif s != 200:
                out.append((False, None))
            else:
                if (b or "") not in known:
                    known[b or ""] = p = RobotFileParser()
                    p.parse((b or "").splitlines())
                p = known[b or ""]
                out.append((p.can_fetch(agent, u) and p.can_fetch("*", u), p.crawl_delay(agent) or p.crawl_delay("*")))
        return pd.DataFrame({"ok": [o for o, _ in out], "delay": [float(d) if d is not None else None for _, d in out]})

    hosts = robots.select(F.col("domain").alias("own_host"), F.col("status").alias("own_status"), F.col("body").alias("own_body")).dropDuplicates(["own_host"])
    joined = urls.withColumn("own_host", url_domain(F.col(url_col))).join(hosts, "own_host", "left")
    j = joined.withColumn("j", judge(F.col(url_col), F.col("own_status"), F.col("own_body")))
    return j.select(*urls.columns, F.col("j.ok").alias("robots_ok"), F.col("j.delay").alias("crawl_delay"))


def frontier(links: DataFrame, seeds: DataFrame, max_depth: int, max_seen: int | None = None) -> DataFrame:
    """url, depth of all URLs reached from the seeds by links (source, link_no, target), level by level.

    A URL has the depth at which it is first seen. Each level is written before the next reads it; where max_seen is
    given, a level's URLs are taken in the order of their parents and links until it is reached.
    """
    edges = links.select(canonical_url(F.col("source")).alias("source"), "link_no", canonical_url(F.col("target")).alias("target"))

    def numbered(rows: DataFrame, *order: str) -> DataFrame:
        """The order matters only under a limit, which bounds what is numbered."""
        if max_seen is None:
            return rows.withColumn("at", F.lit(0))
        left = max_seen - (seen.count() if seen is not None else 0)
        return rows.orderBy(*order).limit(max(0, left)).withColumn("at", F.row_number().over(Window.orderBy(*order)))

    seen = None
    first = seeds.select(canonical_url(F.col("url")).alias("url")).where("url is not null").distinct()
    level = seen = cut_lineage(numbered(first, "url").select("url", "at", F.lit(0).alias("depth")))
    for depth in range(1, max_depth + 1):
        if max_seen is not None and seen.count() >= max_seen:
            break
        found = level.join(edges, level["url"] == edges["source"]).groupBy("target").agg(F.min(F.struct("at", "link_no")).alias("o")).withColumnRenamed("target", "url").join(seen.select("url"), "url", "left_anti")
        placed = numbered(found.select("url", F.col("o.at").alias("parent"), F.col("o.link_no").alias("link_no")), "parent", "link_no", "url")
        level = cut_lineage(placed.select("url", "at", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        seen = cut_lineage(seen.select("url", "at", "depth").unionByName(level))
    return seen.select("url", "depth")


def simulate(pages: DataFrame, seeds: DataFrame, domains: DataFrame, robots: DataFrame, agent: str, max_depth: int, max_pages: int) -> DataFrame:
    """url, depth, status_code, error_message of a crawl over given pages (url, status, content_type, html).

    Discovered URLs count up to three times max_pages. Blocked ones have status 403, unknown ones 0; a page whose content
    type names neither html nor text is left out. Only pages that were fetched lead on.
    """
    clean = cut_lineage(pages.withColumn("url", canonical_url(F.col("url"))).dropDuplicates(["url"]))
    good = clean.where("status = 200 and (lower(content_type) like '%html%' or lower(content_type) like '%text%')")
    open_ = robots_allowed(good, robots, agent).where("robots_ok")
    links = html_links(open_, "url", "url", "html").select(F.col("document_id").alias("source"), "link_no", F.col("link").alias("target"))
    inside = allowed(links.withColumnRenamed("target", "url"), domains).withColumnRenamed("url", "target")
    reached = frontier(inside, allowed(seeds, domains), max_depth, 3 * max_pages)
    visited = robots_allowed(reached, robots, agent).join(clean.select("url", "status", "content_type"), "url", "left")
    status = F.when(~F.col("robots_ok"), 403).otherwise(F.coalesce("status", F.lit(0)))
    readable = F.lower(F.coalesce("content_type", F.lit(""))).rlike("html|text")
    rows = visited.withColumn("status_code", status).where((F.col("status_code") != 200) | readable)
    return rows.orderBy("depth", "url").limit(max_pages).select("url", "depth", "status_code", F.when(~F.col("robots_ok"), "blocked by robots").when(F.col("status_code") == 0, "no answer").when(F.col("status_code") != 200, F.concat(F.lit("status "), "status_code")).alias("error_message"))
