"""The link graph: ``edges(src_url, dst_url, …)`` between pages.

Targets are skewed (home pages, footers), so edges are counted per URL before
anything is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.functions.urls import domain_of, normalize_url


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_url").agg(F.count(F.lit(1)).alias("out_degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(normalize_url("dst_url").alias("url")).agg(F.count(F.lit(1)).alias("in_degree"))


def targets(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Every link target with its in-degree and whether a page table has it."""
    known = pages.select(normalize_url("url").alias("url")).distinct().withColumn("crawled", F.lit(True))
    return in_degrees(edges).join(known, "url", "left").withColumn("crawled", F.coalesce("crawled", F.lit(False)))


def uncrawled(edges: DataFrame, pages: DataFrame) -> DataFrame:
    known = pages.select(normalize_url("url").alias("url")).distinct()
    return in_degrees(edges).join(known, "url", "left_anti")


def domain_counts(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Per domain: its pages, links on them, links to it."""
    parts = (
        pages.select(domain_of("url").alias("domain"), F.lit(1).alias("p"), F.lit(0).alias("o"), F.lit(0).alias("i"))
        .unionAll(edges.select(domain_of("src_url"), F.lit(0), F.lit(1), F.lit(0)))
        .unionAll(edges.select(domain_of("dst_url"), F.lit(0), F.lit(0), F.lit(1))))
    return parts.groupBy("domain").agg(
        F.sum("p").alias("pages"), F.sum("o").alias("links_from"), F.sum("i").alias("links_to"))
