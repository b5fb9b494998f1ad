"""The engine's queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import html, text
from lodestar.functions.stem import english_stopwords, porter
from lodestar.operators import audit, cooccurrence, graph, heavy_keys, index, ranking, rocchio
from lodestar.plans import expansion
from lodestar.session import read_table as _t
from lodestar.session import shared_folder
from lodestar.sources import files

# One query that many pages answer, for what works on one query at a time.
QUESTION = "caracal lynx rivalry"


def _docs(spark, d):
    return files.documents(_t(spark, d, "pages"))


def _index(spark, d):
    return index.build(_docs(spark, d))


def _urls(spark, d):
    return files.url_map(_t(spark, d, "url_mapping"))


def _edges(spark, d):
    return files.edges(_t(spark, d, "web_graph"))


def _queries(spark, d):
    return _t(spark, d, "query_set").select("query_id", "query_text").distinct()


def _scores(spark, d):
    return files.link_scores(graph.pagerank(_edges(spark, d)))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _hits(df):
    return _rounded(df, "score", "tf_idf", "coordination").withColumn("page_rank", F.round("page_rank", 9))


def postings_tf(spark, d):
    return index.postings_of(index.token_table(_docs(spark, d)))


def term_df(spark, d):
    return _index(spark, d).term_df()


def doc_lengths(spark, d):
    return _index(spark, d).doc_len


def collection_stats(spark, d):
    made = _index(spark, d)
    return spark.createDataFrame([(made.n_docs, made.total_len, round(made.average, 6))], "n_docs bigint, total_len bigint, average double")


def search_hybrid(spark, d):
    return _hits(ranking.search(_index(spark, d), _queries(spark, d), _urls(spark, d)))


def search_vsm(spark, d):
    return _hits(ranking.search(_index(spark, d), _queries(spark, d), _urls(spark, d), mode="vsm"))


def search_logtf(spark, d):
    return _hits(ranking.search(_index(spark, d), _queries(spark, d), _urls(spark, d), profile="log_tf"))


def search_with_pagerank(spark, d):
    return _hits(ranking.search(_index(spark, d), _queries(spark, d), _urls(spark, d), _scores(spark, d)))


def query_edge_cases(spark, d):
    asked = spark.createDataFrame(
        [(1, "the and for"), (2, "wolf wolf wolf"), (3, "heron the puma heron lynx shrike"), (4, ""), (5, None), (6, "wo1f wölf ab"), (7, "quxquux")], "query_id bigint, query_text string"
    )
    return _hits(ranking.search(_index(spark, d), asked, _urls(spark, d)))


def doc_metadata(spark, d):
    return _docs(spark, d).select("doc_id", text.title(F.col("text")).alias("title"), text.snippet(F.col("text")).alias("snippet"))


def url_keys(spark, d):
    key = text.normalise_url(F.col("url"))
    return _urls(spark, d).select("doc_id", key.alias("url_key"), text.anchorless(F.col("url")).alias("anchorless"), text.url_host(F.col("url")).alias("host"), text.url_depth_weight(key).alias("depth_weight"))


def page_links(spark, d):
    made = _edges(spark, d).select("src", F.concat(F.lit('<p>see <a class="x" href="'), text.strip(F.col("dst")), F.lit('">there</a> and <a>nowhere</a></p>')).alias("page"))
    return made.select("src", F.explode(html.html_links("page", "src")).alias("dst"))


def page_text(spark, d):
    made = _edges(spark, d).select(F.concat(F.lit("<html><style>p {}</style><p>From "), F.col("src"), F.lit("<!-- no --> to <b>"), text.strip(F.col("dst")), F.lit("</b></p><script>1 < 2</script>")).alias("page"))
    return made.select(html.html_text("page").alias("text")).distinct()


def graph_stats(spark, d):
    return graph.graph_stats(_edges(spark, d))


def pagerank(spark, d):
    return graph.pagerank(_edges(spark, d)).withColumn("pagerank", F.round("pagerank", 9))


def pagerank_top(spark, d):
    return graph.top_nodes(graph.pagerank(_edges(spark, d)), "pagerank").withColumn("score", F.round("score", 9))


def hits(spark, d):
    return graph.hits(_edges(spark, d)).withColumns({c: F.round(c, 8) for c in ("hub", "authority")})


def authorities_top(spark, d):
    return graph.top_nodes(graph.hits(_edges(spark, d)), "authority").withColumn("score", F.round("score", 8))


def hubs_top(spark, d):
    return graph.top_nodes(graph.hits(_edges(spark, d)), "hub").withColumn("score", F.round("score", 8))


def link_scores_saved(spark, d):
    """All link scores of a crawl, saved and read again."""
    path = shared_folder(spark)
    files.save_link_scores(graph.link_scores_table(_edges(spark, d)), path)
    return files.read_link_scores(spark, path).withColumn("pagerank", F.round("pagerank", 9)).withColumns({c: F.round(c, 8) for c in ("hub", "authority")})


def search_loaded(spark, d):
    """Search on an index that was saved and loaded again."""
    path = shared_folder(spark)
    _index(spark, d).save(path)
    return _hits(ranking.search(index.Index.load(spark, path), _queries(spark, d), _urls(spark, d)))


def index_extended(spark, d):
    """Postings of an index that took the pages in two batches, the second with pages it had already."""
    path, docs = shared_folder(spark), _docs(spark, d)
    index.start(spark, path)
    index.extend(path, docs.where("hash(doc_id) % 3 = 0"), "first")
    return index.extend(path, docs, "second").postings


def page_files(spark, d):
    """Pages written as one text file each and read again."""
    path = shared_folder(spark)
    files.write_pages(_docs(spark, d), path)
    return files.read_pages(spark, path)


def map_file(spark, d):
    path = shared_folder(spark)
    files.write_json(_t(spark, d, "url_mapping").select("id", "url"), path)
    return files.read_url_map(spark, path)


def edge_file(spark, d):
    path = shared_folder(spark)
    files.write_json(_t(spark, d, "web_graph").select("src", "dst"), path)
    return files.read_edges(spark, path)


def crawl_state_file(spark, d):
    """Visited and frontier URLs saved and read again: the pages, and the link targets that aren't pages."""
    path = shared_folder(spark)
    visited = _urls(spark, d).select("url").distinct()
    frontier = _edges(spark, d).select(F.col("dst").alias("url")).distinct().join(visited, "url", "left_anti")
    files.write_crawl_state(visited, frontier, path)
    seen, ahead = files.read_crawl_state(spark, path)
    return seen.withColumn("state", F.lit("visited")).union(ahead.withColumn("state", F.lit("frontier")))


def query_file(spark, d):
    """The query set written in its headed text form and read again."""
    path = shared_folder(spark)
    kept = _t(spark, d, "query_set").where("query_text IS NOT NULL AND section IS NOT NULL").select("query_id", "section", text.strip(F.regexp_replace("query_text", r"\s+", " ")).alias("q")).where("q <> ''").distinct()
    numbered = F.transform(F.array_sort(F.collect_list(F.struct("query_id", "q"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["q"]))
    parts = kept.groupBy("section").agg(F.concat_ws("\n", F.concat(F.initcap("section"), F.lit(" queries")), F.array_join(numbered, "\n")).alias("value"))
    # a query set is written by hand, so it is one small file
    parts.agg(F.array_join(F.array_sort(F.collect_list("value")), "\n\n").alias("value")).coalesce(1).write.text(path)
    return files.read_query_set(spark, path)


def competitor_file(spark, d):
    """Stored hits written as one object of hit lists by query and read again."""
    path = shared_folder(spark)
    hit = F.struct(F.lit("stored").alias("engine"), F.lit("").alias("title"), "url", F.lit("").alias("snippet"))
    lists = _t(spark, d, "search_results").where("url IS NOT NULL AND query_id IS NOT NULL").groupBy(F.col("query_id").cast("string").alias("q")).agg(F.collect_set(hit).alias("hits"))
    # the comparison file holds the hits of a handful of queries
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("q", "hits")))).alias("value")).coalesce(1).write.text(path)
    return files.read_competitors(spark, path)


def _first_words(spark, d):
    return _queries(spark, d).select(F.split(F.lower(text.strip(F.col("query_text"))), r"\s+")[0].alias("term")).where("term <> ''").distinct()


def _related(spark, d, measure):
    made = _index(spark, d).kept()
    return _rounded(cooccurrence.best_related(cooccurrence.related(made, _first_words(spark, d)), measure), "score")


def assoc_terms(spark, d):
    return _related(spark, d, "association")


def metric_terms(spark, d):
    return _related(spark, d, "metric")


def scalar_terms(spark, d):
    return _related(spark, d, "scalar")


def expand_cluster(spark, d):
    """Each query expanded by each of the three measures, without the stopwords of the index."""
    made, asked, n = _index(spark, d).kept(), _queries(spark, d), _urls(spark, d).count()
    out = asked.select("query_id")
    for m in cooccurrence.MEASURES:
        out = out.join(expansion.expand_cluster(made, asked, n, m, frozenset(text.INDEX_STOPWORDS)).withColumnRenamed("expanded", m), "query_id", "left")
    return out


def _as_is(c):
    return c


def rocchio_identity(spark, d):
    made = _index(spark, d).kept()
    return _rounded(expansion.rocchio_terms(made, _queries(spark, d), _urls(spark, d), None, _as_is, frozenset(text.INDEX_STOPWORDS)), "score")


def rocchio_porter(spark, d):
    return _rounded(expansion.rocchio_terms(_index(spark, d).kept(), _queries(spark, d), _urls(spark, d), None), "score")


def expand_rocchio(spark, d):
    return expansion.expand_rocchio(_index(spark, d).kept(), _queries(spark, d), _urls(spark, d), None)


def cluster_run(spark, d):
    return expansion.cluster_run(_index(spark, d).kept(), _queries(spark, d))


def ui_search(spark, d):
    return expansion.ui_search(_index(spark, d).kept(), _docs(spark, d), _urls(spark, d), _scores(spark, d), QUESTION)


def compare_six(spark, d):
    return expansion.compare(_index(spark, d).kept(), _docs(spark, d), _urls(spark, d), _scores(spark, d), QUESTION)


def local_vocab(spark, d):
    made = _index(spark, d).kept()
    asked = ranking.one_query(made.postings, QUESTION)
    words = rocchio.query_words(asked, english_stopwords(), porter)
    hits_ = ranking.search(made, asked, _urls(spark, d), top_n=expansion.POOL)
    good = rocchio.feedback(made, words, hits_, relevant=5, others=10).where("rel").select("doc_id")
    return audit.vocabulary(made, [r.doc_id for r in good.collect()])


def rocchio_run(spark, d):
    return expansion.rocchio_run(_index(spark, d).kept(), _queries(spark, d), _urls(spark, d), None)


def demo_batch(spark, d):
    return _rounded(expansion.demo_batch(_index(spark, d).kept(), _docs(spark, d), _queries(spark, d), _urls(spark, d), _scores(spark, d)), "score")


def report(spark, d):
    return expansion.report(_index(spark, d).kept(), _queries(spark, d), _urls(spark, d), None)


def crawl_audit(spark, d):
    return audit.crawl_audit(_docs(spark, d), _t(spark, d, "web_graph"))


def crawl_frontier(spark, d):
    links = _t(spark, d, "web_graph").select(*[text.normalise_url(F.col(c)).alias(c) for c in ("src", "dst")])
    pages = _urls(spark, d).select(text.normalise_url(F.col("url")).alias("url"))
    seeds = _t(spark, d, "query_set").sparkSession.createDataFrame([("https://www.pridewatch.example/",), ("https://www.pridewatch.example/atlas",)], "url string")
    return graph.crawl_levels(links, seeds, pages.union(seeds))


def result_overlap(spark, d):
    """How many of each query's stored hits the engine's own ten best hold, by URL."""
    own = ranking.search(_index(spark, d), _queries(spark, d), _urls(spark, d)).select("query_id", text.normalise_url(F.col("url")).alias("url_key"))
    given = _t(spark, d, "search_results").where("url IS NOT NULL").select("query_id", text.normalise_url(F.col("url")).alias("url_key")).distinct()
    both = given.join(own.withColumn("_own", F.lit(1)), ["query_id", "url_key"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("stored"), F.count("_own").alias("found"))


def p3_found(spark, d):
    return heavy_keys.heavy_urls(_t(spark, d, "web_graph"))


def p3_degrees(spark, d):
    return heavy_keys.url_degrees(_t(spark, d, "web_graph"))


QUERIES = {
    f.__name__: f
    for f in (
        postings_tf, term_df, doc_lengths, collection_stats, search_hybrid, search_vsm, search_logtf, search_with_pagerank, query_edge_cases, doc_metadata, url_keys, page_links, page_text,
        graph_stats, pagerank, pagerank_top, hits, assoc_terms, metric_terms, scalar_terms, expand_cluster, cluster_run, rocchio_identity, rocchio_porter, expand_rocchio, ui_search, compare_six, local_vocab,
        authorities_top, hubs_top, link_scores_saved, search_loaded, index_extended, page_files, map_file, edge_file, crawl_state_file, query_file, competitor_file, rocchio_run, demo_batch, report,
        crawl_audit, crawl_frontier, result_overlap, p3_found, p3_degrees,
    )
}
