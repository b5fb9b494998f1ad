"""SQL for the queries of this package that SQL can express."""

_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_STRIP = f"^{_SPACE}+|{_SPACE}+$"
_HOST = rf"nullif(regexp_extract(lower(regexp_replace(url, '{_STRIP}', '', 'g')), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?(?:www\.)?(\[[^\]]*\]|[^/?#:]+)', 1), '')"
_PAGE = "SELECT doc_id, arg_max(text, (fetched_at, text)) AS text FROM pages WHERE doc_id IS NOT NULL GROUP BY doc_id"
_TERMS = r"""
pg AS (SELECT DISTINCT doc_id, text FROM pages WHERE doc_id IS NOT NULL),
words AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}'))) AS term FROM pg),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
n AS (SELECT sum(tf) AS n FROM tf)"""
_RANKS = """
once AS (SELECT DISTINCT query_id, url, score, tf_idf, coordination, page_rank FROM search_results WHERE query_id IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_hits, row_number() OVER () AS hit FROM once),
long AS (SELECT query_id, hit, 'score' AS s, score AS v FROM sized UNION ALL SELECT query_id, hit, 'tf_idf', tf_idf FROM sized
         UNION ALL SELECT query_id, hit, 'coordination', coordination FROM sized UNION ALL SELECT query_id, hit, 'page_rank', page_rank FROM sized),
ranked AS (SELECT *, rank() OVER (PARTITION BY query_id, s ORDER BY v DESC) AS r FROM long WHERE v IS NOT NULL AND NOT isnan(v)),
wide AS (SELECT z.query_id, z.url, z.n_hits, max(CASE WHEN s = 'score' THEN r END) AS rank_score, max(CASE WHEN s = 'tf_idf' THEN r END) AS rank_tf_idf,
         max(CASE WHEN s = 'coordination' THEN r END) AS rank_coordination, max(CASE WHEN s = 'page_rank' THEN r END) AS rank_page_rank
         FROM sized z LEFT JOIN ranked k ON z.query_id = k.query_id AND z.hit = k.hit GROUP BY z.query_id, z.url, z.n_hits, z.hit)"""

SQL = {
    "p4_found": rf"""
WITH page AS ({_PAGE}),
named AS (SELECT 'page_' || id || '.txt' AS doc_id, min(regexp_replace(url, '{_STRIP}', '', 'g')) AS url FROM url_mapping WHERE id IS NOT NULL AND url IS NOT NULL GROUP BY id),
sited AS (SELECT doc_id, {_HOST} AS host FROM named),
own AS (SELECT page.doc_id, host, text FROM page JOIN sited USING (doc_id) WHERE host IS NOT NULL),
pieces AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM own),
folded AS (SELECT doc_id, host, line_no, trim(regexp_replace(regexp_replace(lower(raw), '[0-9]+', '0', 'g'), '{_SPACE}+', ' ', 'g')) AS line FROM pieces),
counted AS (SELECT host, line, count(DISTINCT doc_id) AS n FROM folded WHERE line <> '' GROUP BY ALL),
sizes AS (SELECT host, count(*) AS pages FROM own GROUP BY host)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM folded JOIN counted USING (host, line) JOIN sizes USING (host) WHERE n >= 8 AND n * 4 >= pages""",
    "p5_found": f"WITH {_TERMS} SELECT doc_id, term FROM tf JOIN df USING (term) WHERE tf >= 5 AND df BETWEEN 2 AND 12",
    "p5_scores": f"""
WITH {_TERMS},
cells AS (SELECT doc_id, term, tf, df, CAST(tf AS DOUBLE) AS a, CAST(cf - tf AS DOUBLE) AS b, CAST(dl - tf AS DOUBLE) AS c, CAST(n - dl - cf + tf AS DOUBLE) AS d,
          CAST(dl AS DOUBLE) AS dl, CAST(cf AS DOUBLE) AS cf, CAST(n AS DOUBLE) AS n FROM tf JOIN df USING (term) JOIN dl USING (doc_id), n)
SELECT doc_id, term, tf, df, round(2 * CASE WHEN a * n >= dl * cf THEN 1 ELSE -1 END * (a * ln(a * n / (dl * cf)) + CASE WHEN b > 0 THEN b * ln(b * n / ((n - dl) * cf)) ELSE 0 END
  + CASE WHEN c > 0 THEN c * ln(c * n / (dl * (n - cf))) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d * n / ((n - dl) * (n - cf))) ELSE 0 END), 3) + 0.0 AS llr FROM cells""",
    "p6_found": f"""
WITH {_RANKS}
SELECT DISTINCT query_id, url FROM wide WHERE n_hits >= 10 AND (rank_score <= 3 IS TRUE)::INT + (rank_tf_idf <= 3 IS TRUE)::INT + (rank_coordination <= 3 IS TRUE)::INT + (rank_page_rank <= 3 IS TRUE)::INT >= 3""",
    "p6_ranking": f"""
WITH {_RANKS},
norm AS (SELECT *, list_sort([coalesce(rank_score / n_hits, 1.0), coalesce(rank_tf_idf / n_hits, 1.0), coalesce(rank_coordination / n_hits, 1.0), coalesce(rank_page_rank / n_hits, 1.0)]) AS x FROM wide),
tails AS (SELECT *, 1 - pow(1 - x[1], 4) AS t1, 6 * pow(x[2], 2) * pow(1 - x[2], 2) + 4 * pow(x[2], 3) * (1 - x[2]) + pow(x[2], 4) AS t2,
          4 * pow(x[3], 3) * (1 - x[3]) + pow(x[3], 4) AS t3, pow(x[4], 4) AS t4 FROM norm),
scored AS (SELECT *, round(least(1.0, 4 * least(t1, t2, t3, t4)), 9) AS rho FROM tails)
SELECT query_id, url, n_hits, rank_score, rank_tf_idf, rank_coordination, rank_page_rank, rho, rank() OVER (PARTITION BY query_id ORDER BY rho) AS place FROM scored""",
}
_SCORED = SQL["p6_ranking"].rsplit("SELECT query_id, url, n_hits", 1)[0]
SQL["p6_top"] = f"""
{_SCORED}
SELECT query_id, url, rho, CAST(place AS INTEGER) AS place FROM (
  SELECT query_id, url, rho, row_number() OVER (PARTITION BY query_id ORDER BY rho, round(list_sum(x), 9), url NULLS FIRST) AS place FROM scored) WHERE place <= 10"""
SQL["p5_top"] = f"""
WITH scored AS ({SQL["p5_scores"].replace("), 3) + 0.0 AS llr", "), 6) AS llr")}),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY llr DESC, term) AS place FROM scored WHERE df >= 2)
SELECT doc_id, CAST(place AS INTEGER) AS place, term, round(llr, 3) AS llr FROM placed WHERE place <= 10"""
SQL["p4_clean"] = f"""
WITH found AS ({SQL["p4_found"]}), cut AS (SELECT doc_id, list(line_no) AS c FROM found GROUP BY doc_id), pg AS ({_PAGE})
SELECT pg.doc_id, CASE WHEN c IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(c, i)), chr(10)) END AS text
FROM pg LEFT JOIN cut ON cut.doc_id = pg.doc_id"""
