"""Crawl-log operators (G1, G2, E6, I2, I3, C36): first-seen dedup, zero-streak stop,
resume anti-join, page URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_row_count
from .ranks import cumulative_counts

# Fixed value: pages without new links after which a group's crawl stops.
ZERO_STREAK_LIMIT = 6


def page_new_counts(log: DataFrame, grp: str = "grp", page: str = "page", pos: str = "pos",
                    link: str = "link", max_pages: int | None = None) -> DataFrame:
    """Per (group, page): links first seen in the group on that page (0 when none).
    First occurrences come from an aggregate, so a hot link combines map-side."""
    if max_pages is not None:
        log = log.where(F.col(page) <= max_pages)
    first = log.groupBy(grp, link).agg(F.min(F.struct(page, pos)).alias("_f"))
    new = first.groupBy(grp, F.col("_f")[page].alias(page)).agg(
        F.count(F.lit(1)).alias("new_count"))
    pages = log.select(grp, page).distinct()
    return pages.join(new, [grp, page], "left").select(
        grp, page, F.coalesce(F.col("new_count"), F.lit(0)).cast("long").alias("new_count"))


def zero_streak_stop(log: DataFrame, grp: str = "grp", page: str = "page", pos: str = "pos",
                     link: str = "link", limit: int = ZERO_STREAK_LIMIT,
                     max_pages: int | None = None) -> DataFrame:
    """Per group and page the new-link count, the zero streak, and whether the page is
    read (pages after the one where the streak reaches ``limit`` are not). Every page counts
    unless the caller gives ``max_pages``. A page's row number and the number of pages with
    new links up to it are chunked prefix sums, so a long group is never one task's window;
    pages with the same number of such pages before them form one run of zeros."""
    pc = page_new_counts(log, grp, page, pos, link, max_pages)
    cum = cumulative_counts(pc, [grp], page, {
        "new_count": F.col("new_count"), "r": F.lit(1), "nz": (F.col("new_count") > 0).cast("int")})
    runs = cum.groupBy(F.col(grp).alias("_g"), F.col("cum_nz").alias("_nz")).agg(
        F.min("cum_r").alias("_first"))
    streak = F.col("cum_r") - F.when(F.col("cum_nz") > 0, F.col("_first")).otherwise(0)
    cum = cum.join(runs, F.col(grp).eqNullSafe(F.col("_g")) & (F.col("cum_nz") == F.col("_nz"))).select(
        grp, page, "new_count", streak.cast("long").alias("zero_streak"))
    stops = cum.where(F.col("zero_streak") >= limit).groupBy(F.col(grp).alias("_g")).agg(
        F.min(page).alias("stop_page"))
    if bounded_row_count(stops) is not None:
        stops = F.broadcast(stops)
    return cum.join(stops, F.col(grp).eqNullSafe(F.col("_g")), "left").select(
        grp, page, "new_count", "zero_streak",
        (F.col("stop_page").isNull() | (F.col(page) <= F.col("stop_page"))).alias("read"))


def first_seen(log: DataFrame, group_order: Column | None = None, grp: str = "grp",
               page: str = "page", pos: str = "pos", link: str = "link",
               limit: int = ZERO_STREAK_LIMIT, max_pages: int | None = None) -> DataFrame:
    """G1: links collected per group on the pages actually read, then deduplicated across
    groups - a link belongs to the first group (``group_order``) that shows it."""
    read = zero_streak_stop(log, grp, page, pos, link, limit, max_pages).where("read").select(
        grp, page)
    kept = log.join(read, [grp, page])
    first = kept.groupBy(grp, link).agg(F.min(F.struct(page, pos)).alias("_f"))
    go = group_order if group_order is not None else F.col(grp)
    glob = first.groupBy(link).agg(F.min(F.struct(go.alias("_go"), F.col("_f")[page].alias("p"),
                                                  F.col("_f")[pos].alias("q"),
                                                  F.col(grp).alias("g"))).alias("_w"))
    return glob.select(F.col("_w")["g"].alias("source_group"), link,
                       F.col("_w")["p"].alias("page"), F.col("_w")["q"].alias("pos"))


def unprocessed_links(links: DataFrame, done: DataFrame, link: str = "link") -> DataFrame:
    """Links not yet in the result table (resume)."""
    return links.join(done.select(link).where(F.col(link).isNotNull()).distinct(), link,
                      "left_anti")


def page_urls(groups: DataFrame, n_pages: Column | int, url: str = "url",
              old_style: bool = False) -> DataFrame:
    """One row per (group, page): page 1 is the base URL; later pages append
    ``&page=n`` or ``?page=n`` (old form: always ``?page=n``)."""
    n = F.lit(n_pages) if isinstance(n_pages, int) else n_pages
    g = groups.select("*", F.explode(F.sequence(F.lit(1), n)).alias("page"))
    sep = F.lit("?") if old_style else F.when(F.col(url).contains("?"), F.lit("&")).otherwise(F.lit("?"))
    page_url = F.when(F.col("page") == 1, F.col(url)).otherwise(
        F.concat(F.col(url), sep, F.lit("page="), F.col("page").cast("string")))
    if old_style:
        page_url = F.concat(F.col(url), sep, F.lit("page="), F.col("page").cast("string"))
    return g.withColumn("page_url", page_url)
