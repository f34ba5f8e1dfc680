"""Link extraction and a bounded breadth-first walk over stored pages."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import html, url
from tessera.operators.ranking import cap_per_source, top_k_per_key
from tessera.session import cut_lineage


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(url, link)`` edges: followable targets, absolute, no fragment.

    Targets are distinct and sorted within their page, which needs no shuffle; a
    page stored twice gives its links twice.
    """
    page = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    targets = F.transform(
        F.filter(html.hrefs(F.col("html")), url.is_followable),
        lambda h: url.resolve_link(F.col("url"), h),
    )
    links = page.withColumn("links", F.array_sort(F.array_distinct(targets)))
    return links.select("url", F.explode("links").alias("link"))


def admitted_links(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges a source admits: ``(source, url, link)``.

    ``sources`` holds source, host, allow_prefixes and deny_substrings; a link is
    checked against the sources of its own host only.
    """
    keyed = edges.withColumn("host", url.host(F.col("link")))
    admitted = url.is_admitted(F.col("link"), F.col("allow_prefixes"), F.col("deny_substrings"))
    return keyed.join(sources, "host").where(admitted).select("source", "url", "link")


def walk(
    seeds: DataFrame,
    edges: DataFrame,
    max_depth: int | None = None,
    max_pages: int = config.MAX_PAGES_PER_SOURCE,
) -> DataFrame:
    """``(source, url, depth)`` of the pages visited, at most ``max_pages`` per source.

    ``seeds``: source, url.  ``edges``: source, url, link.  Rounds follow the links
    of the last frontier that were not seen yet, until a round finds nothing (or, if
    given, ``max_depth`` is reached).  The edges are materialised once, every round is
    checkpointed.  Visits are ordered by
    (depth, url); since a page beyond the cap is never visited, its links are not
    followed either.
    """
    edges = cut_lineage(edges.select("source", "url", "link").distinct())
    visited = cap_per_source(
        seeds.select("source", "url").distinct(), "source", [F.col("url")], max_pages
    ).withColumn("depth", F.lit(0))
    visited = cut_lineage(visited)
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        frontier = visited.where(F.col("depth") == depth - 1).select("source", "url")
        found = (
            edges.join(frontier, ["source", "url"], "left_semi")
            .select("source", F.col("link").alias("url"))
            .distinct()
            .join(visited, ["source", "url"], "left_anti")
        )
        room = visited.groupBy("source").agg((F.lit(max_pages) - F.count("*")).alias("_room"))
        next_pages = (
            top_k_per_key(found, ["source"], [F.col("url")], max_pages, "_n")
            .join(room, "source")
            .where(F.col("_n") <= F.col("_room"))
            .select("source", "url", F.lit(depth).alias("depth"))
        )
        next_pages = cut_lineage(next_pages)
        if next_pages.isEmpty():
            break
        visited = cut_lineage(visited.unionByName(next_pages))
    return visited


def unseen(found: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Frontier difference: found rows whose key was not seen."""
    return found.join(seen.select(*keys).distinct(), keys, "left_anti")

