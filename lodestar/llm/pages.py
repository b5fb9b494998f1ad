"""Pages as one row each, with the site they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import strip, url_host
from lodestar.session import written
from lodestar.sources.files import documents, page_id


def one_per_id(pages: DataFrame) -> DataFrame:
    """``(doc_id, text)``: one row per doc_id; of rows that differ the latest counts, then the greatest text.

    Rows without a doc_id are dropped, as nothing could be said of them.
    """
    return documents(pages)


def sites(url_mapping: DataFrame) -> DataFrame:
    """``(doc_id, url, host)`` of every mapped page. Of several URLs of one id the least counts; NULL URLs don't count."""
    return (
        url_mapping.where("id IS NOT NULL AND url IS NOT NULL")
        .groupBy(page_id(F.col("id")).alias("doc_id"))
        .agg(F.min(strip(F.col("url"))).alias("url"))
        .withColumn("host", url_host(F.col("url")))
    )


def site_pages(pages: DataFrame, url_mapping: DataFrame) -> DataFrame:
    """``(doc_id, text, host, site)``; host and its number, site, are NULL for a page without a URL: it has no site."""
    site = F.when(F.col("host").isNotNull(), F.xxhash64("host")).alias("site")
    return one_per_id(pages).join(sites(url_mapping).select("doc_id", "host"), "doc_id", "left").select("doc_id", "text", "host", site)


def kept_pages(pages: DataFrame, url_mapping: DataFrame) -> DataFrame:
    """The same, written once to the shared folder: the only time that texts are shuffled, however often they are read."""
    return written(site_pages(pages, url_mapping))
