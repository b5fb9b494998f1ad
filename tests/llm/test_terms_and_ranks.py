import math
import random
import re
from collections import Counter

import pytest

from lodestar.llm import distinctive_terms, queries, rank_fusion

PAGES = "doc_id string, text string, fetched_at timestamp, term string, tf bigint"


def _pages(spark, rows):
    return spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], PAGES)


def _llr(a, b, c, d):
    n = a + b + c + d
    cell = lambda o, r, k: o * math.log(o * n / (r * k)) if o else 0
    g = cell(a, a + c, a + b) + cell(b, b + d, a + b) + cell(c, a + c, c + d) + cell(d, b + d, c + d)
    return 2 * g if a * n >= (a + c) * (a + b) else -2 * g


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(distinctive_terms, "HELD_TERMS", 20)
    random.seed(2)
    words = ["wolf", "Lion", "the", "heron", "abc1", "wölf", "ab", "x_y", "puma"]
    rows = [(f"p{i}", " ".join(random.choices(words, weights=range(9, 0, -1), k=random.randint(0, 60)))) for i in range(30)]
    rows += [("e", ""), ("n", None), ("b", " \n"), ("long", "lynx " * 50_000)]
    rows += rows[:5]  # repeated rows are one page
    count = {d: Counter(re.findall(r"\b[a-z]{3,}\b", (t or "").lower())) for d, t in rows}
    df = Counter(t for c in count.values() for t in c)
    cf = sum(count.values(), Counter())
    n = cf.total()
    for low, top in ((1, None), (2, 20)):
        got = {(r.doc_id, r.term): (r.tf, r.df, r.llr) for r in distinctive_terms.distinctive_terms(_pages(spark, rows), 2, low, top).collect()}
        want = {
            (d, t): (f, df[t], _llr(f, cf[t] - f, c.total() - f, n - c.total() - cf[t] + f))
            for d, c in count.items() for t, f in c.items() if f >= 2 and df[t] >= low and (top is None or df[t] <= top)
        }
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k])


def test_no_pages(spark):
    assert distinctive_terms.distinctive_terms(_pages(spark, []), 5, 2, 12).count() == 0


def test_every_pair_has_a_score(spark, tmp_path):
    # "wolf" and "lynx" on 25 pages, above any limit, and terms that occur once, in one page
    rows = [(f"p{i}", f"wolf wolf only{chr(97 + i)}x lynx") for i in range(25)] + [("e", ""), ("n", None), ("x", "single")]
    _pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["p5_scores"](spark, str(tmp_path)).collect()
    want = {(d, t): n for d, x in rows for t, n in Counter(re.findall(r"\b[a-z]{3,}\b", x or "")).items()}
    assert {(r.doc_id, r.term): r.tf for r in got} == want and len(got) == len(want)
    df = Counter(t for _, t in want)
    assert all(r.df == df[r.term] for r in got) and df["wolf"] == 25
    score = {(r.doc_id, r.term): r.llr for r in got}
    assert score["x", "single"] > score["p3", "onlydx"] > abs(score["p3", "wolf"])


def test_top_terms(spark):
    rows = [(f"p{i}", f"wolf wolf rare{chr(97 + i // 2)}x rare{chr(97 + i // 2)}x lynx only{chr(97 + i)}") for i in range(20)] + [("e", ""), ("n", None)]
    got = distinctive_terms.top_terms(_pages(spark, rows), top=2).collect()
    best = {r.doc_id: r.term for r in got if r.place == 1}
    assert len(got) == 40 and best == {f"p{i}": f"rare{chr(97 + i // 2)}x" for i in range(20)}  # common terms count little, those of one page are left out
    assert distinctive_terms.top_terms(_pages(spark, [])).count() == 0


HITS = "query_id bigint, url string, score double, tf_idf double, coordination double, page_rank double, run_at timestamp, rank string"


def _rows():
    random.seed(4)
    nan, out = float("nan"), []
    for q in range(6):
        for i in range(4 + 9 * q):
            value = lambda s: random.choice([None, nan, 0.0, -1.0, 1e300, 1e-300, random.random() * s, random.random() * s, 0.5])  # noqa: B023, E731
            out.append((q, f"u{i}", value(1), value(1e6), random.choice([0.0625, 1.0, 0.5]), value(1e-6), None, "r"))
    return [*out, *out[:7], (None, "u", 1.0, 1.0, 1.0, 1.0, None, "r"), (3, None, 2.0, 2.0, 2.0, 2.0, None, "r")]


def _brute(rows):
    out = {}
    once = list(dict.fromkeys((q, u, *("nan" if x != x else x for x in s)) for q, u, *s, _, _ in rows if q is not None))
    for q in {r[0] for r in once}:
        hits = [r for r in once if r[0] == q]
        ranks = []
        for h in hits:
            own = []
            for k in range(2, 6):
                v = h[k]
                own.append(None if v in (None, "nan") else 1 + sum(o[k] not in (None, "nan") and o[k] > v for o in hits))
            r = sorted(1.0 if x is None else x / len(hits) for x in own)
            rho = min(1.0, 4 * min(sum(math.comb(4, j) * r[k - 1] ** j * (1 - r[k - 1]) ** (4 - j) for j in range(k, 5)) for k in range(1, 5)))
            ranks.append((h, own, round(rho, 9)))
        for h, own, rho in ranks:
            out[h] = (len(hits), own, rho, 1 + sum(o[2] < rho for o in ranks))
    return out


def test_fused_ranking_matches_brute_force(spark):
    rows = _rows()
    want = sorted((h[0], str(h[1]), n, [str(x) for x in own], rho, place) for h, (n, own, rho, place) in _brute(rows).items())
    got = rank_fusion.fused_ranking(spark.createDataFrame(rows, HITS)).collect()
    got = sorted((r.query_id, str(r.url), r.n_hits, [str(r[f"rank_{s}"]) for s in rank_fusion.SCORES], r.rho, r.place) for r in got)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=2e-9)


def test_best_fused(spark):
    rows = _rows()
    got = rank_fusion.best_fused(spark.createDataFrame(rows, HITS), top=5).collect()
    assert len({(r.query_id, r.place) for r in got}) == len(got)
    for q in {r[0] for r in rows if r[0] is not None}:
        want = sorted(rho for h, (_, _, rho, _) in _brute(rows).items() if h[0] == q)[:5]
        assert sorted(r.rho for r in got if r.query_id == q) == pytest.approx(want, abs=2e-9)
    assert rank_fusion.best_fused(spark.createDataFrame([], HITS)).count() == 0


def test_agreed_best(spark):
    rows = _rows()
    want = {(h[0], h[1]) for h, (n, own, *_) in _brute(rows).items() if n >= 10 and sum(x is not None and x <= 3 for x in own) >= 3}
    assert {tuple(r) for r in rank_fusion.agreed_best(spark.createDataFrame(rows, HITS)).collect()} == want
    assert rank_fusion.agreed_best(spark.createDataFrame([], HITS)).count() == 0


def test_agreed_best_goes_by_the_beta_tail(spark, monkeypatch):
    rows, tail = _rows(), rank_fusion.beta_tail
    brute = {h: (n, sorted(x for x in own if x is not None)) for h, (n, own, *_) in _brute(rows).items()}
    hits = spark.createDataFrame(rows, HITS)
    for top, agree in ((3, 2), (12, 3), (60, 4)):  # more than half of the hits, and more than all
        want = {(h[0], h[1]) for h, (n, own) in brute.items() if n >= 10 and len(own) >= agree and own[agree - 1] <= top}
        assert {tuple(r) for r in rank_fusion.agreed_best(hits, top, agree).collect()} == want
    # turned around, the tail gives the other hits
    monkeypatch.setattr(rank_fusion, "beta_tail", lambda *a, **k: -tail(*a, **k))
    want = {(h[0], h[1]) for h, (n, own) in brute.items() if n >= 10 and len(own) >= 3 and own[2] > 3}
    assert {tuple(r) for r in rank_fusion.agreed_best(hits).collect()} == want


def test_neighbouring_places_of_many_hits(spark):
    n = 10**9
    for top in (3, n // 2 - 1, n // 2, n - 2):
        row = spark.sql(f"SELECT {top} / {n} AS a, {top + 1} / {n} AS b, {n} AS n")
        got = row.select(*[rank_fusion.as_unlikely(row[x], row["n"], top, 3, 4).alias(x) for x in "ab"]).first()
        assert (got.a, got.b) == (True, False)
