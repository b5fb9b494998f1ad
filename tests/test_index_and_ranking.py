import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import INDEX_STOPWORDS
from lodestar.operators import index, ranking
from lodestar.sources import files

DOCS = [
    ("a", "wolf wolf lion and the wolf"),
    ("b", "lion heron heron"),
    ("c", "wolf lion heron lion puma"),
    ("d", ""),
    ("e", None),
    ("f", "wolf lion heron lion puma"),
    ("g", "wölf ab 123 wo1f"),
]
URLS = [("a", "http://x.test/"), ("b", "http://x.test/one/two"), ("c", "http://x.test/one/two/three"), ("f", " HTTP://X.test/one/two/THREE ")]
QUERIES = [(1, "wolf heron"), (2, "the and for"), (3, "Wolf wolf lion"), (4, None), (5, ""), (6, "puma lion wolf heron"), (7, "nothing")]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    urls = spark.createDataFrame(URLS, "doc_id string, url string")
    return index.build(docs), urls, spark.createDataFrame(QUERIES, "query_id bigint, query_text string")


def _search(query, mode="hybrid", log_tf=False, scores=None, top=10):
    words = {d: [w for w in re.findall(r"\b[a-z]{3,}\b", (t or "").lower()) if w not in INDEX_STOPWORDS] for d, t in DOCS}
    posts = defaultdict(dict)
    for d, ws in words.items():
        for w, n in Counter(ws).items():
            posts[w][d] = n
    n = len(DOCS)
    average = sum(map(len, words.values())) / n
    raw = re.findall(r"\b[a-z]{3,}\b", (query or "").lower())
    terms = raw if log_tf else ([w for w in raw if w not in INDEX_STOPWORDS] or raw)
    total, seen, first = defaultdict(float), defaultdict(set), {}
    for i, t in enumerate(terms):
        if t in posts:
            idf = math.log10(n / len(posts[t]))
            for d, f in posts[t].items():
                total[d] += idf * (1 + math.log10(f)) if log_tf else idf * (5 if i < 2 else 1) * f / (0.1 + 0.9 * len(words[d]) / average)
                seen[d].add(t)
                first.setdefault(d, i)
    urls, out, met = dict(URLS), [], set()
    for d in sorted(total, key=lambda d: (first[d], d)):
        url = urls.get(d, d).strip() if d in urls else d
        key = url.lower()
        if key in met:
            continue
        met.add(key)
        pr = (scores or {}).get(key, 0)
        c = (len(seen[d]) / len(set(terms))) ** 4
        slashes = key.count("/")
        score = (total[d] + 1000 * pr) * c * (0.3 if slashes <= 3 else 2 if slashes >= 5 else 1)
        if score > 0:
            out.append((d, score, total[d], c, pr))
    out.sort(key=lambda r: (-round(r[2 if mode == "vsm" else 1], 9), r[0]))
    return out[:top]


def test_figures_count_documents_without_terms(corpus):
    made, *_ = corpus
    assert made.n_docs == 7 and made.total_len == 17
    assert {r.doc_id: r.dl for r in made.doc_len.collect()} == {"a": 4, "b": 3, "c": 5, "f": 5}


@pytest.mark.parametrize("mode,log_tf,ranked", [("hybrid", False, False), ("vsm", False, False), ("hybrid", True, False), ("hybrid", False, True)])
def test_search_matches_brute_force(spark, corpus, mode, log_tf, ranked):
    made, urls, queries = corpus
    scores = {"http://x.test/": 0.02, "b": 0.5} if ranked else None
    table = files.link_scores(spark.createDataFrame([("HTTP://x.test/ ", 0.02), ("http://x.test/", 0.01), ("b", 0.5)], "url string, pagerank double")) if ranked else None
    rows = ranking.search(made, queries, urls, table, mode=mode, profile="log_tf" if log_tf else "length_norm", top_n=3).collect()
    for q, text in QUERIES:
        want = _search(text, mode, log_tf, scores, 3)
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r.place)
        assert [r.doc_id for r in got] == [w[0] for w in want], q
        for r, w in zip(got, want, strict=True):
            assert (r.score, r.tf_idf, r.coordination, r.page_rank) == pytest.approx(w[1:])


def test_saved_index_and_growth(spark, corpus, tmp_path):
    made, urls, queries = corpus
    made.save(str(tmp_path / "whole"))
    again = index.Index.load(spark, str(tmp_path / "whole"))
    key = lambda r: (r.query_id, r.place)
    assert sorted(ranking.search(again, queries, urls).collect(), key=key) == sorted(ranking.search(made, queries, urls).collect(), key=key)
    path = str(tmp_path / "grown")
    index.start(spark, path)
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    index.extend(path, docs.where("doc_id < 'c'"), "one")
    index.extend(path, docs.where("doc_id < 'c'"), "one")  # repeated after a failure
    index.extend(path, docs.withColumn("text", F.when(F.col("doc_id") == "a", "changed texts aren't read again").otherwise(F.col("text"))), "two")
    grown = index.Index.load(spark, path)
    assert (grown.n_docs, grown.total_len) == (7, 17)
    assert sorted(map(tuple, grown.postings.collect())) == sorted(map(tuple, made.postings.collect()))


def test_empty_corpus(spark):
    none = index.build(spark.createDataFrame([], "doc_id string, text string"))
    assert none.average == index.DEFAULT_LENGTH
    queries = spark.createDataFrame([(1, "wolf")], "query_id bigint, query_text string")
    assert ranking.search(none, queries, spark.createDataFrame([], "doc_id string, url string")).count() == 0
