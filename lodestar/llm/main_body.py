"""The main body of each page among menus, notices, sidebars and footers, by the model of body_model.

The model is fitted on a sample of whole sites of bounded size, chosen by a hash, and applied to every page. Pages of
residue and keyword pages have no body; their own operators tell which they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import keyword_pages, residue
from lodestar.llm.body_model import Boosted, Features, fit, furniture_lines
from lodestar.llm.pages import kept_pages

SAMPLE_SITES, SITE_PAGES = 128, 32  # the model sees at most this many sites and pages of each
LEAST_PAGES = 8  # of a site in the sample: recurrence tells nothing on smaller ones
LONGEST_SAMPLED = 100_000  # characters; longer pages aren't drawn into the sample


def _sample(kept: DataFrame, sites: int, pages: int) -> list[tuple[str, str]]:
    """(text, host) of the sample; at most sites * pages texts of at most LONGEST_SAMPLED characters reach the driver."""
    able = kept.where(f"host IS NOT NULL AND length(text) BETWEEN 1 AND {LONGEST_SAMPLED}")
    chosen = able.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES).orderBy(F.xxhash64(F.lit(11), "host"), "host").limit(sites).select("host")
    order = Window.partitionBy("host").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id")
    ids = able.select("host", "doc_id").join(F.broadcast(chosen), "host").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= pages).select("doc_id")
    rows = able.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "host").collect()
    return [(r.text, r.host) for r in sorted(rows, key=lambda r: r.doc_id)]


def _judge(model: Boosted, weights: dict[str, float]):
    """Made once in a task: tells the furniture of pages."""

    def start():
        made = Features(weights)
        return lambda pages: furniture_lines(pages, made, model)

    return start


def _read(pages: DataFrame, url_mapping: DataFrame, edges: DataFrame, sites: int, site_pages: int) -> tuple[DataFrame, DataFrame]:
    """The kept pages, and ``(doc_id, lines)`` of those that have a body. Lines are read once, for residue, keywords and bodies."""
    kept = kept_pages(pages, url_mapping)
    model, weights = fit(_sample(kept, sites, site_pages))
    read = residue.lines_of(kept, entry_of=keyword_pages.kind_of, furniture=_judge(model, weights))
    counted = residue.site_counts(read)
    sized = residue.recurrent(read, counted)
    stuffed = keyword_pages.judged(keyword_pages.evidence_of(read, kept, url_mapping, edges, sized)).where("keyword_page").select("doc_id")
    without = residue.residue_of(read, counted, sized).unionByName(stuffed).distinct()
    return kept, read.select("doc_id", F.col("furniture").alias("lines")).join(without, "doc_id", "left_anti")


def furniture(pages: DataFrame, url_mapping: DataFrame, edges: DataFrame, sites: int = SAMPLE_SITES, site_pages: int = SITE_PAGES) -> DataFrame:
    """``(doc_id, line_no)`` of the non-blank lines outside the main body, line_no from 1.

    Pages with residue and keyword pages have no body, so they have no rows; NULL and blank pages have none either.
    The model is fitted on at most ``sites`` sites and ``site_pages`` pages of each, and applied to all pages. Where no site
    has LEAST_PAGES pages there is nothing to learn from, and every line counts as body.
    """
    return _read(pages, url_mapping, edges, sites, site_pages)[1].select("doc_id", F.explode("lines").alias("line_no"))


def main_bodies(pages: DataFrame, url_mapping: DataFrame, edges: DataFrame, sites: int = SAMPLE_SITES, site_pages: int = SITE_PAGES) -> DataFrame:
    """``(doc_id, body)``: the main body of each page that has one; the lines of the body stay as they are."""
    kept, good = _read(pages, url_mapping, edges, sites, site_pages)
    pieces = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("t"), (i + 1).cast("int").alias("k")))
    left = F.transform(F.filter(pieces, lambda p: ~F.array_contains(F.col("lines"), p["k"])), lambda p: p["t"])
    return kept.select("doc_id", "text").join(good, "doc_id").select("doc_id", F.array_join(left, "\n").alias("body")).where("body RLIKE '[^\\\\s\\\\p{Z}]'")
