"""A breadth-first walk over pages that are already at hand as rows."""

from __future__ import annotations

from functools import reduce
from urllib.robotparser import RobotFileParser
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.shared import kept
from textloom.functions.text import html_links, html_text, html_title, url_host, url_normalised, url_resolved


class CrawlError(Exception):
    """The walk can't start."""


def links_of(pages: DataFrame) -> DataFrame:
    """(src, pos, dst): resolved links on the page's own host, in order."""
    found = pages.select(F.col("url").alias("src"), F.posexplode(html_links(F.col("html"))).alias("pos", "link"))
    return found.select("src", "pos", url_resolved(F.col("link"), F.col("src")).alias("dst")).where(url_host(F.col("dst")) == url_host(F.col("src")))


def walk(links: DataFrame, start: str, max_depth: int | None = None) -> DataFrame:
    """(url, level, path): pages in the order a queue would reach them, that is by level and path.

    A page's path is that of the page that first links to it and its place there, so no global numbering is needed.
    """
    frontier = kept(links.sparkSession.createDataFrame([(start, 0, "")], "url string, level int, path string"))
    levels = [frontier]  # each is written once
    while max_depth is None or len(levels) <= max_depth:
        reached = frontier.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url"), F.concat("path", F.lpad(F.col("pos").cast("string"), 6, "0"), F.lit("/")).alias("path"))
        new = reached.groupBy("url").agg(F.min("path").alias("path"))
        for seen in levels:
            new = new.join(seen.select("url"), "url", "left_anti")
        frontier = kept(new.select("url", F.lit(len(levels)).alias("level"), "path"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def allowed(robots: str | None, urls: list[str], agent: str = "*") -> list[str]:
    """Addresses that a robots file permits; without one, all."""
    if robots is None:
        return urls
    rules = RobotFileParser()
    rules.parse(robots.splitlines())
    return [u for u in urls if rules.can_fetch(agent, u)]


def crawl(pages: DataFrame, start: str, max_pages: int | None = None) -> DataFrame:
    """(url, title, text, level, path) of pages reached from start on its host, first of equal texts only.

    Pages whose text an earlier one has are left out, but their links are followed.
    """
    if not urlsplit(start).netloc:
        raise CrawlError("the start address needs a host")
    own = pages.withColumn("url", url_normalised(F.col("url")))
    order = walk(links_of(own), url_normalised_text(start))
    clean = own.join(order, "url").select("url", html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"), "level", "path")
    kept = first_of_equal(clean, "text", ["level", "path"]).orderBy("level", "path")
    return kept if max_pages is None else kept.limit(max_pages)


def url_normalised_text(url: str) -> str:
    return url.split("#", 1)[0]


def first_of_equal(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The first row of each content by its SHA-1; partial minima make large groups cheap."""
    marked = rows.withColumn("digest", F.sha1(F.coalesce(F.col(column), F.lit("")).cast("binary")))
    first = marked.groupBy("digest").agg(F.min(F.struct(*order)).alias("first"))
    return marked.join(first.select(*[F.col("first")[c].alias(c) for c in order], "digest"), ["digest", *order], "left_semi").drop("digest")
