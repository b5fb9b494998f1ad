from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestar.operators import heavy_keys

SCHEMA = "src string, dst string, key string, n bigint"


def _edges(spark):
    rows = [("Hot ", f"d{i % 7}", "k", i) for i in range(500)] + [("\thot\n", None, None, 1), (None, "D1", "x", 2), (None, None, None, None), ("", "d1", "", 0)]
    rows += [(f"s{i}", "d1", "k", i) for i in range(40)] * 2
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_degrees_match_brute_force(spark):
    rows, df = _edges(spark)
    links, partners = Counter(), defaultdict(set)
    for s, d, *_ in rows:
        s, d = (x if x is None else x.strip().lower() for x in (s, d))
        for side, a, b in (("src", s, d), ("dst", d, s)):
            if a is not None:
                links[side, a] += 1
                if b is not None:
                    partners[side, a].add(b)
    got = {(r.side, r.url): (r.n_links, r.n_partners) for r in heavy_keys.url_degrees(df, blocks=3).collect()}
    assert got == {k: (n, len(partners[k])) for k, n in links.items()}


def test_heavy_urls_count_all_rows(spark):
    rows, df = _edges(spark)
    got = {tuple(r) for r in heavy_keys.heavy_urls(df, percent=10, blocks=2).collect()}
    assert ("src", "hot") in got and ("dst", "d1") in got and ("src", "s1") not in got


def test_empty_and_small_buffers(spark, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    assert heavy_keys.url_degrees(empty).count() == 0 and heavy_keys.heavy_urls(empty).count() == 0
    rows, df = _edges(spark)
    monkeypatch.setattr(heavy_keys, "FLUSH_AT", 4)
    counts = heavy_keys.key_counts(df, {"src": F.col("src")}, blocks=2)
    assert {r.key: r.n for r in counts.collect()} == Counter(s for s, *_ in rows if s is not None)
