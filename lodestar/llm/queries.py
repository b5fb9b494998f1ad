"""The queries of this package over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.llm import distinctive_terms, encode, keyword_pages, main_body, mixing, mojibake, rank_fusion, repeated_lines, residue
from lodestar.session import read_table as _t


def p1_found(spark, d):
    return residue.residue_pages(_t(spark, d, "pages"), _t(spark, d, "url_mapping"))


def p1_clean(spark, d):
    return residue.without_residue(_t(spark, d, "pages"), _t(spark, d, "url_mapping")).select("doc_id", "text").distinct()


def p2_found(spark, d):
    return main_body.furniture(_t(spark, d, "pages"), _t(spark, d, "url_mapping"), _t(spark, d, "web_graph"))


def p2_bodies(spark, d):
    return main_body.main_bodies(_t(spark, d, "pages"), _t(spark, d, "url_mapping"), _t(spark, d, "web_graph"))


def p4_found(spark, d):
    return repeated_lines.repeated_lines(_t(spark, d, "pages"), _t(spark, d, "url_mapping"))


def p4_clean(spark, d):
    return repeated_lines.without_repeated_lines(_t(spark, d, "pages"), _t(spark, d, "url_mapping"))


def p4_passages(spark, d):
    return repeated_lines.repeated_passages(_t(spark, d, "pages"), _t(spark, d, "url_mapping"))


def p7_found(spark, d):
    return keyword_pages.keyword_pages(_t(spark, d, "pages"), _t(spark, d, "url_mapping"), _t(spark, d, "web_graph"))


def p7_evidence(spark, d):
    return keyword_pages.keyword_evidence(_t(spark, d, "pages"), _t(spark, d, "url_mapping"), _t(spark, d, "web_graph"))


def p5_found(spark, d):
    return distinctive_terms.distinctive_terms(_t(spark, d, "pages"), min_tf=5, min_df=2, max_df=12).select("doc_id", "term")


def p5_scores(spark, d):
    """The score of every term of every page."""
    return distinctive_terms.distinctive_terms(_t(spark, d, "pages")).withColumn("llr", F.round("llr", 3) + 0.0)


def p5_top(spark, d):
    return distinctive_terms.top_terms(_t(spark, d, "pages")).withColumn("llr", F.round(F.round("llr", 6), 3))


def p6_found(spark, d):
    return rank_fusion.agreed_best(_t(spark, d, "search_results"))


def p6_ranking(spark, d):
    return rank_fusion.fused_ranking(_t(spark, d, "search_results")).withColumn("rho", F.round("rho", 9))


def p6_top(spark, d):
    return rank_fusion.best_fused(_t(spark, d, "search_results"))


def p8_ids(spark, d):
    return encode.encoded(_t(spark, d, "documents"))


def p9_found(spark, d):
    return mixing.unfillable(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_mix(spark, d):
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.shares(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p10_found(spark, d):
    return mojibake.garbled_documents(_t(spark, d, "documents"))


def p10_restored(spark, d):
    return mojibake.restored(_t(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_bodies, p4_found, p4_clean, p4_passages, p7_found, p7_evidence, p5_found, p5_scores, p5_top, p6_found, p6_ranking, p6_top, p8_ids, p9_found, p9_mix, p9_shares, p10_found, p10_restored)}
