import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.operators import index, ranking, scoring

POSTING = pa.list_(pa.struct([("number", pa.int32()), ("tf", pa.int64())]))


def _docs(n, seed):
    rng = random.Random(seed)
    keys = [rng.choice(["hot"] * 3 + [f"u{i % 40:02}" for i in range(n)]) for _ in range(n)]
    rows = [(k, f"d{i:03}", k.upper(), rng.randint(1, 9), rng.choice([0.3, 1.0, 2.0]), rng.choice([0.0, 0.01]), {t: rng.randint(1, 3) for t in rng.sample(range(5), rng.randint(1, 4))}) for i, k in enumerate(keys)]
    return sorted(rows, key=lambda r: (r[0], r[1]))


def _brute(rows, form, idf, top_n):
    _, n_terms, terms = form
    seen, out = {}, []
    for key, doc, url, dl, depth, link, tf in rows:
        met = [(first, t, w) for t, w, first in terms if t in tf]
        if met:
            total = sum(idf[t] * w * tf[t] for _, t, w in met) / (0.1 + 0.9 * dl / 4)
            score = (total + 1000 * link) * (len(met) / n_terms) ** 4 * depth
            seen[key] = min(seen.get(key, (99,)), (min(met)[0], doc, score))
    out = [(round(-s, 9), d) for _, d, s in seen.values() if s > 0]
    return [d for _, d in sorted(out)[:top_n]]


@pytest.mark.parametrize("block", [3, 7, 1 << 14])
def test_urls_that_span_blocks_count_once(monkeypatch, block):
    monkeypatch.setattr(scoring, "BLOCK", block)
    forms = [(0, 2, [(0, 5.0, 0), (1, 5.0, 1)]), (1, 3, [(4, 5.0, 0), (2, 1.0, 2), (0, 5.0, 1)]), (2, 1, [(3, 10.0, 0)]), (3, 2, [(2, 5.0, 0), (9, 5.0, 1)])]
    idf = np.array([0.2, 0.4, 0.6, 0.0, 0.3] + [0.0] * 5)
    for seed in range(5):
        rows = _docs(60, seed)
        columns = [pa.array([r[i] for r in rows]) for i in range(6)] + [pa.array([[{"number": t, "tf": n} for t, n in r[6].items()] for r in rows], POSTING)]
        whole = pa.RecordBatch.from_arrays(columns, names=["url_key", "doc_id", "url", "dl", "depth", "page_rank", "terms"])
        run = scoring.best_hits(forms, idf, 4.0, 1000.0, False, False, 4)
        got = [r for b in run(whole.slice(at, 11) for at in range(0, 60, 11)) for r in b.to_pylist()]
        for form in forms:
            mine = sorted((r for r in got if r["form"] == form[0]), key=lambda r: (-round(r["score"], 9), r["doc_id"]))
            assert [r["doc_id"] for r in mine[:4]] == _brute(rows, form, idf, 4), (seed, form)


def test_equal_hits_leave_a_task_only_as_far_as_they_may_be_among_the_best():
    n = 500
    columns = [pa.array([f"u{i:03}" for i in range(n)]), pa.array([f"d{i:03}" for i in range(n)]), pa.array(["x"] * n), pa.array([4] * n), pa.array([1.0] * n), pa.array([0.0] * n), pa.array([[{"number": 0, "tf": 1}]] * n, POSTING)]
    batch = pa.RecordBatch.from_arrays(columns, names=["url_key", "doc_id", "url", "dl", "depth", "page_rank", "terms"])
    got = [r["doc_id"] for b in scoring.best_hits([(0, 1, [(0, 1.0, 0)])], np.ones(1), 4.0, 1000.0, False, False, 10)(iter([batch])) for r in b.to_pylist()]
    assert got == [f"d{i:03}" for i in range(10)]


@pytest.mark.parametrize("mode,profile", [("hybrid", "length_norm"), ("vsm", "length_norm"), ("hybrid", "log_tf")])
def test_passes_and_repeated_queries_give_the_same_hits(spark, monkeypatch, mode, profile):
    docs = spark.createDataFrame([(f"p{i}", " ".join(["wolf"] * (i % 3) + ["lion"] * (i % 4) + ["heron"] * (i % 5))) for i in range(40)], "doc_id string, text string")
    urls = spark.createDataFrame([(f"p{i}", f"http://x.test/{i % 30}/a/b") for i in range(35)], "doc_id string, url string")
    texts = ["wolf lion", "Wolf  lion", "heron", "lion wolf heron", None, "puma", "heron"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query_text string")
    made = index.build(docs)
    search = lambda: sorted(map(tuple, ranking.search(made, queries, urls, mode=mode, profile=profile, top_n=4).collect()))
    one = search()
    of = lambda rows, q: [r[1:] for r in rows if r[0] == q]
    assert of(one, 0) == of(one, 1) and of(one, 2) == of(one, 6) and len(of(one, 3)) == 4 and not of(one, 4) and not of(one, 5)
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", 2)
    assert search() == one
    assert not any(math.isnan(r[4]) for r in one)
