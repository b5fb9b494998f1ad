"""What a crawl holds: pages, empty and small ones, links, their sources; and the words of chosen documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import INDEX_STOPWORDS
from lodestar.operators.index import Index

EXPECTED_PAGES, SMALL_BYTES, COVERAGE = 100_000, 100, 0.5


def crawl_audit(docs: DataFrame, links: DataFrame) -> DataFrame:
    """One row ``(pages, empty_pages, small_pages, edges, corrupt_edges, unique_sources, too_few_pages, low_coverage)``.

    Sizes are in bytes, a NULL text is empty; a link without one of its ends is corrupt.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    pages = docs.agg(
        F.count("*").alias("pages"), F.count_if(size == 0).alias("empty_pages"), F.count_if((size > 0) & (size < SMALL_BYTES)).alias("small_pages")
    ).first()
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    edges = links.agg(F.count_if(whole).alias("edges"), F.count_if(~whole).alias("corrupt_edges"), F.countDistinct(F.when(whole, F.col("src"))).alias("unique_sources"))
    few = pages.pages < EXPECTED_PAGES
    low = (F.col("edges") > 0) & (F.col("unique_sources") < COVERAGE * pages.pages)
    return edges.select(
        *[F.lit(v).cast("bigint").alias(k) for k, v in pages.asDict().items()], "edges", "corrupt_edges", "unique_sources", F.lit(few).alias("too_few_pages"), low.alias("low_coverage")
    )


def vocabulary(index: Index, doc_ids: list[str], longest_list: int = 200) -> DataFrame:
    """One row ``(terms, listing)``: the number of terms of the documents with more than four letters, and the first of them joined by semicolons."""
    own = index.postings.where(F.col("doc_id").isin(*doc_ids)).where((F.length("term") > 4) & ~F.col("term").isin(*INDEX_STOPWORDS)).select("term").distinct()
    first = own.orderBy("term").limit(longest_list)
    return first.agg(F.array_join(F.sort_array(F.collect_list("term")), ";").alias("listing")).select(F.lit(own.count()).cast("bigint").alias("terms"), "listing")
