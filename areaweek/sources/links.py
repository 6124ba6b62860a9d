"""Listing pages to document links and the list of documents still to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweek.functions.urls import anchors, file_name, resolve
from areaweek.operators.names import behind
from areaweek.sources.tables import pending

NEXT_TEXTS = ("next", ">")


def page_links(
    pages: DataFrame, marker: str = "download=", url: str = "url", html: str = "html"
) -> DataFrame:
    """Absolute links whose target contains ``marker``, each once per page, with
    its position among them."""
    hits = F.filter(anchors(F.col(html)), lambda a: F.contains(a["href"], F.lit(marker)))
    targets = F.array_distinct(F.transform(hits, lambda a: resolve(F.col(url), a["href"])))
    others = [c for c in pages.columns if c != html]
    return pages.select(*others, F.posexplode(targets).alias("pos", "link"))


def next_link(
    pages: DataFrame,
    texts: tuple[str, ...] = NEXT_TEXTS,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """The page each listing continues on: its first anchor with one of ``texts``."""
    wanted = F.filter(anchors(F.col(html)), lambda a: F.lower(a["text"]).isin(*texts))
    others = [c for c in pages.columns if c != html]
    found = pages.select(*others, F.get(wanted, F.lit(0))["href"].alias("_href"))
    return behind(found, next_url=resolve(F.col(url), F.col("_href"))).drop("_href")


def pending_pages(
    pages: DataFrame, texts: tuple[str, ...] = NEXT_TEXTS, url: str = "url", html: str = "html"
) -> DataFrame:
    """Listing pages to fetch next: where the stored ones continue, less those stored.

    Repeated until there is none, this is the crawl; each round fetches all of them.
    """
    ahead = next_link(pages.select(url, html), texts, url, html)
    wanted = ahead.select(F.col("next_url").alias(url)).where(F.col(url).isNotNull()).distinct()
    return wanted.join(pages.select(url).distinct(), url, "left_anti")


def pending_links(
    pages: DataFrame,
    manifest: DataFrame,
    order: str,
    marker: str = "download=",
    param: str = "download",
    default: str = "file",
    year_hint: str | None = "year",
) -> DataFrame:
    """Documents to fetch: every file name not in the manifest, with the first
    link that leads to it in page order."""
    links = page_links(pages, marker)
    hint: Column | None = F.col(year_hint) if year_hint else None
    named = behind(links, filename=file_name(F.col("link"), param, default, hint))
    first = named.groupBy("filename").agg(
        F.min(F.struct(F.col(order), F.col("pos"), F.col("link"))).alias("_first")
    )
    return pending(first.select("filename", F.col("_first.link").alias("link")), manifest)
