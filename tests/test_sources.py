import json

from lodestar.functions import text
from lodestar.operators import audit, index
from lodestar.sources import files
from lodestar.streaming import incremental
from pyspark.sql import functions as F


def test_files(spark, tmp_path):
    (tmp_path / "pages" / "sub").mkdir(parents=True)
    (tmp_path / "pages" / "page_1.txt").write_bytes("Wölf\n".encode() + b"\xff lion")
    (tmp_path / "pages" / "sub" / "page_2.txt").write_bytes(b"")
    got = {r.doc_id: r.text for r in files.read_pages(spark, str(tmp_path / "pages")).collect()}
    assert got == {"page_1.txt": "Wölf\n lion", "page_2.txt": ""}

    (tmp_path / "map.jsonl").write_text("\n".join(map(json.dumps, [{"id": 1, "url": " http://a\t"}, {"id": 1, "url": "http://b"}, {"id": 2, "url": None}, {"url": "x"}])))
    assert [tuple(r) for r in files.read_url_map(spark, str(tmp_path / "map.jsonl")).collect()] == [("page_1.txt", "http://a")]
    assert files.read_url_map(spark, str(tmp_path / "none.jsonl")).count() == 0

    (tmp_path / "graph.jsonl").write_text('{"src": "a", "dst": "b"}\nbroken\n{"src": "a"}\n{"src": "a", "dst": "b"}\n')
    assert [tuple(r) for r in files.read_edges(spark, str(tmp_path / "graph.jsonl")).collect()] == [("a", "b")] * 2

    (tmp_path / "queries.txt").write_text("--- Rocchio queries ---\n1. wolf den\n2. lion\n\nCluster queries\n1. Owl. And more\nnot one\n")
    assert [tuple(r) for r in files.read_query_set(spark, str(tmp_path / "queries.txt")).orderBy("query_id").collect()] == [(1, "rocchio", "wolf den"), (2, "rocchio", "lion"), (3, "cluster", "Owl. And more")]

    hit = {"engine": "e", "title": "t", "url": "u", "snippet": None}
    (tmp_path / "other.json").write_text(json.dumps({"q": [hit, hit], "none": []}, indent=1))
    assert [tuple(r) for r in files.read_competitors(spark, str(tmp_path / "other.json")).collect()] == [("q", "e", "t", "u", None)] * 2

    ahead = spark.createDataFrame([(f"b{i:05}",) for i in range(50_001)], "url string")
    files.write_crawl_state(spark.createDataFrame([("a",)], "url string"), ahead, str(tmp_path / "state"))
    visited, frontier = files.read_crawl_state(spark, str(tmp_path / "state"))
    assert [r.url for r in visited.collect()] == ["a"] and frontier.count() == 50_001
    files.write_crawl_state(visited.limit(0), ahead, str(tmp_path / "less"), most=7)
    visited, frontier = files.read_crawl_state(spark, str(tmp_path / "less"))
    assert visited.count() == 0 and sorted(r.url for r in frontier.collect()) == [f"b{i:05}" for i in range(7)]


def test_pages_as_files(spark, tmp_path):
    docs = spark.createDataFrame([("page_1.txt", "Wölf"), ("page 2%+.txt", ""), ("page_3.txt", None), (None, "x")], "doc_id string, text string")
    files.write_pages(docs, str(tmp_path / "pages"))
    got = {r.doc_id: r.text for r in files.read_pages(spark, str(tmp_path / "pages")).collect()}
    assert got == {"page_1.txt": "Wölf", "page 2%+.txt": "", "page_3.txt": ""}


def test_link_scores_as_file(spark, tmp_path):
    scores = spark.createDataFrame([("a", 0.5, 0.25, 1.0)], "url string, pagerank double, hub double, authority double")
    files.save_link_scores(scores, str(tmp_path / "scores"))
    assert [tuple(r) for r in files.read_link_scores(spark, str(tmp_path / "scores")).collect()] == [("a", 0.5, 0.25, 1.0)]


def test_one_row_per_document(spark):
    rows = [("a", "old", "2025-01-01"), ("a", "new", "2025-01-02"), ("a", "new", "2025-01-02"), ("b", None, "2025-01-01"), (None, "x", "2025-01-01")]
    pages = spark.createDataFrame(rows, "doc_id string, text string, at string").select("doc_id", "text", F.to_timestamp("at").alias("fetched_at"))
    assert sorted((r.doc_id, r.text) for r in files.documents(pages).collect()) == [("a", "new"), ("b", None)]


def test_stream_grows_an_index(spark, tmp_path):
    source, path, ckpt = (str(tmp_path / n) for n in ("in", "index", "ckpt"))
    index.start(spark, path)

    def arrive(rows):
        made = spark.createDataFrame(rows, "doc_id string, text string").withColumn("fetched_at", F.to_timestamp(F.lit("2025-01-01")))
        made.coalesce(1).write.mode("append").parquet(source)
        incremental.grow(spark, source, path, ckpt).awaitTermination(120)
        return index.Index.load(spark, path)

    assert arrive([("a", "wolf lion"), ("b", "")]).n_docs == 2
    grown = arrive([("a", "changed words"), ("c", "wolf wolf")])
    assert (grown.n_docs, grown.total_len) == (3, 4)
    assert sorted(map(tuple, grown.postings.collect())) == [("lion", "a", 1), ("wolf", "a", 1), ("wolf", "c", 2)]


def test_audit_and_vocabulary(spark):
    docs = spark.createDataFrame([("a", "x" * 99), ("b", "wolverine lions den wolverine"), ("c", ""), ("d", None), ("e", "é" * 50)], "doc_id string, text string")
    links = spark.createDataFrame([("s", "d"), ("s", "d"), (None, "d"), ("t", None)], "src string, dst string")
    r = audit.crawl_audit(docs, links).first()
    assert (r.pages, r.empty_pages, r.small_pages, r.edges, r.corrupt_edges, r.unique_sources, r.too_few_pages, r.low_coverage) == (5, 2, 2, 2, 2, 1, True, True)
    made = index.build(docs)
    assert tuple(audit.vocabulary(made, ["b"]).first()) == (2, "lions;wolverine")
    assert tuple(audit.vocabulary(made, ["absent"]).first()) == (0, "")
    assert docs.select(text.title(F.col("text"))).count() == 5
