"""SQL for the engine's queries that SQL can express."""

_SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_STRIP = f"^{_SPACE}+|{_SPACE}+$"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '{_STRIP}', '', 'g')"


_STOP = "('the','a','an','and','or','but','is','in','on','at','to','for','with')"


def _words(c: str) -> str:
    return rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}'))"


_INDEX = f"""
docs AS (SELECT doc_id, arg_max(text, (fetched_at, coalesce(text, ''))) AS text FROM pages WHERE doc_id IS NOT NULL GROUP BY doc_id),
toks AS (SELECT doc_id, list_filter({_words("text")}, lambda x: x NOT IN {_STOP}) AS w FROM docs),
tokrows AS (SELECT doc_id, unnest(w) AS term FROM toks),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM tokrows GROUP BY ALL),
dls AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
dfs AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf * tf) AS norm2 FROM post GROUP BY term),
cst AS (SELECT CAST((SELECT count(*) FROM docs) AS DOUBLE) AS n, CAST((SELECT coalesce(sum(tf), 0) FROM post) AS DOUBLE) AS total),
urls AS (SELECT 'page_' || id || '.txt' AS doc_id, min({_strip("url")}) AS url FROM url_mapping WHERE id IS NOT NULL AND url IS NOT NULL GROUP BY id)"""
_ASKED = "asked AS (SELECT DISTINCT query_id, query_text FROM query_set)"
_EDGES = """
e AS (SELECT src, dst, count(*) AS mult FROM web_graph WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL),
nds AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e),
o AS MATERIALIZED (SELECT src, sum(mult) AS links FROM e GROUP BY src),
c AS (SELECT count(*) AS c FROM nds)"""


def _pagerank() -> str:
    steps = [_EDGES, "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / c AS x FROM nds, c)"]
    for k in range(1, 21):
        p = f"r{k - 1}"
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT nds.node, 0.15::DOUBLE / c + 0.85::DOUBLE * (SELECT coalesce(sum(x), 0) FROM {p} WHERE node NOT IN (SELECT src FROM o)) / c + 0.85::DOUBLE * coalesce(s, 0) AS x"
            f" FROM nds CROSS JOIN c LEFT JOIN (SELECT e.dst, sum(x * mult / links) AS s FROM e JOIN o ON e.src = o.src JOIN {p} ON {p}.node = e.src GROUP BY e.dst) f ON f.dst = nds.node)"
        )
    return ",\n".join(steps)


def _hits() -> str:
    steps = [_EDGES, "h0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS x FROM nds)"]
    for k in range(1, 21):
        steps.append(f"a{k}r AS (SELECT nds.node, coalesce(s, 0)::DOUBLE AS x FROM nds LEFT JOIN (SELECT dst, sum(x * mult) AS s FROM e JOIN h{k - 1} ON node = src GROUP BY dst) f ON f.dst = nds.node)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT node, x / (SELECT coalesce(nullif(sqrt(sum(x * x)), 0), 1) FROM a{k}r) AS x FROM a{k}r)")
        steps.append(f"h{k}r AS (SELECT nds.node, coalesce(s, 0)::DOUBLE AS x FROM nds LEFT JOIN (SELECT src, sum(x * mult) AS s FROM e JOIN a{k} ON node = dst GROUP BY src) f ON f.src = nds.node)")
        steps.append(f"h{k} AS MATERIALIZED (SELECT node, x / (SELECT coalesce(nullif(sqrt(sum(x * x)), 0), 1) FROM h{k}r) AS x FROM h{k}r)")
    return ",\n".join(steps)


def _search(asked: str = _ASKED, mode: str = "hybrid", log_tf: bool = False, ranked: bool = False, top: int = 10) -> str:
    raw = _words("coalesce(query_text, '')")
    terms = "raw" if log_tf else f"CASE WHEN len(list_filter(raw, lambda x: x NOT IN {_STOP})) > 0 THEN list_filter(raw, lambda x: x NOT IN {_STOP}) ELSE raw END"
    weight = "1.0" if log_tf else "CASE WHEN pos < 2 THEN 5.0 ELSE 1.0 END"
    tf = "(1 + log10(tf))" if log_tf else "tf"
    norm = "1" if log_tf else "(0.1 + 0.9 * (coalesce(dl, total / n) / (total / n)))"
    with_scores = f",\n{_pagerank()},\nscores AS (SELECT lower({_strip('node')}) AS url_key, max(x) AS pr FROM r20 GROUP BY ALL)" if ranked else ",\nscores AS (SELECT '' AS url_key, 0.0 AS pr WHERE false)"
    order = "tf_idf" if mode == "vsm" else "score"
    return f"""
WITH {_INDEX}, {asked}{with_scores},
qraw AS (SELECT query_id, {raw} AS raw FROM asked),
qt AS (SELECT query_id, {terms} AS t FROM qraw),
qrow AS (SELECT query_id, len(list_distinct(t)) AS n_terms, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM qt),
qterm AS (SELECT query_id, term, n_terms, sum({weight}) AS weight, min(pos) AS first_pos FROM qrow GROUP BY ALL),
raws AS (SELECT query_id, p.doc_id, n_terms, sum(log10(n / df) * weight * {tf}) AS s, count(*) AS matched, min(first_pos) AS first_pos
         FROM qterm q JOIN dfs USING (term) JOIN post p USING (term), cst GROUP BY query_id, p.doc_id, n_terms),
named AS (SELECT query_id, r.doc_id, n_terms, s / {norm} AS tf_idf, matched, first_pos, coalesce(url, r.doc_id) AS url FROM raws r LEFT JOIN dls USING (doc_id) LEFT JOIN urls USING (doc_id), cst),
keyed AS (SELECT *, lower({_strip("url")}) AS url_key FROM named),
once AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY query_id, url_key ORDER BY first_pos, doc_id) = 1),
scored AS (SELECT query_id, doc_id, url, tf_idf, pow(matched / n_terms, 4) AS coordination, coalesce(pr, 0.0) AS page_rank,
           (tf_idf + 1000 * coalesce(pr, 0.0)) * pow(matched / n_terms, 4) * CASE WHEN len(url_key) - len(replace(url_key, '/', '')) <= 3 THEN 0.3 WHEN len(url_key) - len(replace(url_key, '/', '')) >= 5 THEN 2.0 ELSE 1.0 END AS score
           FROM once LEFT JOIN scores USING (url_key)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({order}, 9) DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT query_id, place, doc_id, url, round(score, 6) AS score, round(tf_idf, 6) AS tf_idf, round(coordination, 6) AS coordination, round(page_rank, 9) AS page_rank FROM best WHERE place <= {top}"""


_EDGE_CASES = """asked AS (SELECT * FROM (VALUES (1, 'the and for'), (2, 'wolf wolf wolf'), (3, 'heron the puma heron lynx shrike'), (4, ''), (5, NULL), (6, 'wo1f wölf ab'), (7, 'quxquux')) v(query_id, query_text))"""
_RELATED = f"""
kept AS (SELECT term, df, norm2 FROM dfs, cst WHERE df <= n * 0.01 AND term NOT IN {_STOP} AND len(term) >= 3),
own AS (SELECT seed, doc_id, tf FROM seeds JOIN post ON post.term = seed),
uu AS (SELECT seed, sum(tf * tf) AS c_uu FROM own GROUP BY seed),
uv AS (SELECT o.seed, p.term, sum(o.tf * p.tf) * log10(any_value(n) / any_value(df)) AS c_uv, any_value(norm2) AS c_vv FROM own o JOIN post p ON p.doc_id = o.doc_id JOIN kept k ON k.term = p.term, cst WHERE p.term <> o.seed GROUP BY o.seed, p.term),
measured AS (SELECT seed, term, c_uv AS association, c_uv / nullif(c_uu + c_vv - c_uv, 0) AS metric, c_uv / nullif(sqrt(c_uu) * sqrt(c_vv), 0) AS scalar FROM uv JOIN uu USING (seed))"""
_SEEDS = rf"seeds AS (SELECT DISTINCT string_split_regex(lower({_strip('query_text')}), '\s+')[1] AS seed FROM query_set WHERE query_text IS NOT NULL AND {_strip('query_text')} <> '')"


def _best(measure: str, k: int = 5) -> str:
    return f"SELECT seed, term, {measure} AS score, row_number() OVER (PARTITION BY seed ORDER BY round({measure}, 9) DESC, term) AS place FROM measured WHERE {measure} IS NOT NULL QUALIFY place <= {k}"


def _related(measure: str) -> str:
    return f"WITH {_INDEX}, {_SEEDS}, {_RELATED}, best AS ({_best(measure)}) SELECT seed, place, term, round(score, 6) AS score FROM best"


def _rocchio() -> str:
    """Expansion of all queries without stemming, with the stopwords of the index, from their 50 best hits."""
    idf = "CASE WHEN df >= 3 THEN least(log10(n / df), 3.0) ELSE 0.0 END"
    return rf"""
WITH {_INDEX}, {_ASKED},
qw AS (SELECT query_id, unnest(list_filter(string_split_regex(lower(query_text), '\s+'), lambda x: x <> '' AND x NOT IN {_STOP})) AS term FROM asked),
stems AS (SELECT query_id, term, count(*) AS n_q FROM qw GROUP BY ALL),
hits AS (SELECT *, string_split(lower(url), '#')[1] AS base FROM ({_search(top=50)})),
once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, base ORDER BY place) = 1),
held AS (SELECT o.query_id, o.doc_id, count(*) AS k FROM once o JOIN stems s ON s.query_id = o.query_id JOIN post p ON p.term = s.term AND p.doc_id = o.doc_id WHERE place <= 15 GROUP BY ALL),
need AS (SELECT query_id, least(2, count(*)) AS need FROM stems GROUP BY query_id),
good AS (SELECT o.query_id, o.doc_id, true AS rel FROM once o LEFT JOIN held h ON h.query_id = o.query_id AND h.doc_id = o.doc_id LEFT JOIN need d ON d.query_id = o.query_id
         WHERE place <= 15 AND coalesce(k, 0) >= coalesce(need, 0) QUALIFY row_number() OVER (PARTITION BY o.query_id ORDER BY place) <= 3),
given AS MATERIALIZED (SELECT * FROM good UNION ALL SELECT query_id, doc_id, false FROM once WHERE place > 40 AND query_id IN (SELECT query_id FROM good)),
vraw AS (SELECT doc_id, p.term, (1 + log10(tf)) * ({idf}) AS w FROM post p JOIN dfs ON dfs.term = p.term, cst WHERE doc_id IN (SELECT doc_id FROM given)),
vec AS MATERIALIZED (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM vraw WHERE w <> 0),
about AS (SELECT g.query_id, g.doc_id, coalesce(sum(v.w), 0) > 0.15 AS ok FROM given g LEFT JOIN (SELECT s.query_id, v.* FROM vec v JOIN stems s ON s.term = v.term) v ON v.query_id = g.query_id AND v.doc_id = g.doc_id WHERE rel GROUP BY ALL),
chosen AS (SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS m FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS one FROM about) WHERE ok OR NOT one),
rel AS MATERIALIZED (SELECT query_id, term, sum(w / m) AS r, count(*) AS n_rel FROM chosen JOIN vec USING (doc_id) GROUP BY ALL),
non AS (SELECT query_id, term, sum(w / m) AS o, count(*) AS n_non FROM (SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS m FROM given WHERE NOT rel) JOIN vec USING (doc_id) GROUP BY ALL),
qraw2 AS (SELECT query_id, s.term, (1 + log10(n_q)) * coalesce({idf}, 0.0) AS w FROM stems s LEFT JOIN dfs ON dfs.term = s.term, cst WHERE query_id IN (SELECT query_id FROM good)),
q0 AS (SELECT query_id, term, CASE WHEN sum(w * w) OVER (PARTITION BY query_id) > 0 THEN w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) ELSE w END AS q FROM qraw2),
allt AS (SELECT query_id, term, sum(q) AS q, sum(r) AS r, sum(o) AS o, sum(n_rel) AS n_rel, sum(n_non) AS n_non FROM (
   SELECT query_id, term, q, 0.0 AS r, 0.0 AS o, 0 AS n_rel, 0 AS n_non FROM q0 UNION ALL SELECT query_id, term, 0, r, 0, n_rel, 0 FROM rel UNION ALL SELECT query_id, term, 0, 0, o, 0, n_non FROM non) GROUP BY ALL),
vals AS MATERIALIZED (SELECT a.*, q + 0.4 * r - 0.1 * o AS val, coalesce(df, 0) AS df, coalesce({idf}, 0.0) AS idf FROM allt a LEFT JOIN dfs ON dfs.term = a.term, cst WHERE q + 0.4 * r - 0.1 * o > 0),
heavy AS (SELECT query_id, term, r FROM rel QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(r, 12) DESC, term) <= 10),
themes AS (SELECT query_id, theme, sum(share) AS share FROM (SELECT query_id, term AS theme, n_q / sum(n_q) OVER (PARTITION BY query_id) AS share FROM stems
   UNION ALL SELECT query_id, term, r / count(*) OVER (PARTITION BY query_id) FROM heavy) GROUP BY ALL),
pairs AS (SELECT DISTINCT v.term, t.theme FROM vals v JOIN themes t ON t.query_id = v.query_id),
both_ AS MATERIALIZED (SELECT x.term, x.theme, count(*) AS b FROM pairs x JOIN post p ON p.term = x.term JOIN post z ON z.term = x.theme AND z.doc_id = p.doc_id GROUP BY ALL),
sig AS (SELECT v.query_id, v.term, sum(share * b / v.df * log10(1 + (b / td.df) / (v.df / n))) AS signal FROM vals v JOIN themes t ON t.query_id = v.query_id JOIN both_ b ON b.term = v.term AND b.theme = t.theme JOIN dfs td ON td.term = t.theme, cst WHERE v.df > 0 GROUP BY ALL),
scored AS (SELECT v.*, val * (n_rel + 1) / (n_non + 1) * CASE WHEN v.df < 3 THEN 0.01 ELSE greatest(0.01, 0.1 + coalesce(signal, 0)) END * (1 + idf) AS score FROM vals v LEFT JOIN sig s ON s.query_id = v.query_id AND s.term = v.term),
kept AS (SELECT * FROM (SELECT *, avg(score) OVER (PARTITION BY query_id) AS mean FROM scored) c WHERE score > 1.5 * mean AND n_rel >= 2 AND len(term) > 2 AND term NOT IN {_STOP}
   AND NOT EXISTS (SELECT 1 FROM stems s WHERE s.query_id = c.query_id AND s.term = c.term)),
best AS (SELECT query_id, term, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, term) AS place FROM kept)
SELECT query_id, place, term, round(score, 6) AS score FROM best WHERE place <= 5"""


def _cluster_run() -> str:
    joined = ", ".join(f"coalesce((SELECT string_agg(term, ' ' ORDER BY place) FROM ({_best(m, 3)}) b WHERE b.seed = f.seed), '') AS {m}" for m in ("association", "metric", "scalar"))
    first = rf"string_split_regex(lower({_strip('query_text')}), '\s+')[1]"
    return f"WITH {_INDEX}, {_ASKED}, {_SEEDS}, {_RELATED}, f AS (SELECT query_id, {first} AS seed FROM asked) SELECT query_id, {joined} FROM f"


_LINES = rf"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
_ENDS = f"""ends AS (SELECT lower({_strip('src')}) AS src, lower({_strip('dst')}) AS dst FROM web_graph),
sided AS (SELECT 'src' AS side, src AS url, dst AS other FROM ends UNION ALL SELECT 'dst', dst, src FROM ends)"""
_HOST = r"nullif(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?(?:www\.)?(\[[^\]]*\]|[^/?#:]+)', 1), '')"

SQL = {
    "postings_tf": f"WITH {_INDEX} SELECT term, doc_id, tf FROM post",
    "term_df": f"WITH {_INDEX} SELECT term, df FROM dfs",
    "doc_lengths": f"WITH {_INDEX} SELECT doc_id, CAST(dl AS BIGINT) AS dl FROM dls",
    "collection_stats": f"WITH {_INDEX} SELECT CAST(n AS BIGINT) AS n_docs, CAST(total AS BIGINT) AS total_len, round(total / n, 6) AS average FROM cst",
    "search_hybrid": _search(),
    "search_vsm": _search(mode="vsm"),
    "search_logtf": _search(log_tf=True),
    "search_with_pagerank": _search(ranked=True),
    "query_edge_cases": _search(_EDGE_CASES),
    "doc_metadata": f"""
WITH {_INDEX}, lined AS (SELECT doc_id, {_LINES} AS l FROM docs)
SELECT doc_id, coalesce(substring(l[1], 1, 100), 'Untitled Page') AS title, CASE WHEN len(l) > 0 THEN substring(array_to_string(l, ' '), 1, 200) || '...' ELSE 'No snippet available.' END AS snippet FROM lined""",
    "url_keys": f"""
WITH {_INDEX}, k AS (SELECT doc_id, lower(url) AS url_key, string_split(lower(url), '#')[1] AS anchorless, url FROM urls)
SELECT doc_id, url_key, anchorless, {_HOST} AS host, CASE WHEN len(url_key) - len(replace(url_key, '/', '')) <= 3 THEN 0.3 WHEN len(url_key) - len(replace(url_key, '/', '')) >= 5 THEN 2.0 ELSE 1.0 END AS depth_weight FROM k""",
    # joining lower-cases the scheme of a link only if it is that of its page
    "page_links": f"""
SELECT src, CASE WHEN lower(regexp_extract({_strip("src")}, '^[A-Za-z]+:')) = lower(regexp_extract({_strip("dst")}, '^[A-Za-z]+:'))
  THEN lower(regexp_extract({_strip("dst")}, '^[A-Za-z]+:')) || regexp_replace({_strip("dst")}, '^[A-Za-z]+:', '') ELSE {_strip("dst")} END AS dst FROM web_graph WHERE src IS NOT NULL AND dst IS NOT NULL""",
    "page_text": f"SELECT DISTINCT 'From ' || src || ' to ' || {_strip('dst')} AS text FROM web_graph WHERE src IS NOT NULL AND dst IS NOT NULL",
    "graph_stats": f"""
WITH {_EDGES}, deg AS (SELECT node, coalesce((SELECT sum(mult) FROM e WHERE e.dst = node), 0) AS i, coalesce((SELECT sum(mult) FROM e WHERE e.src = node), 0) AS o FROM nds)
SELECT count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, (SELECT node FROM deg ORDER BY i DESC, node LIMIT 1) AS max_in_url, CAST(max(i) AS BIGINT) AS max_in, (SELECT node FROM deg ORDER BY o DESC, node LIMIT 1) AS max_out_url, CAST(max(o) AS BIGINT) AS max_out FROM deg""",
    "pagerank": f"WITH {_pagerank()} SELECT node AS url, round(x, 9) AS pagerank FROM r20",
    "pagerank_top": f"WITH {_pagerank()} SELECT CAST(row_number() OVER (ORDER BY round(x, 12) DESC, node) AS INTEGER) AS place, node AS url, round(x, 9) AS score FROM r20 ORDER BY round(x, 12) DESC, node LIMIT 5",
    "hits": f"WITH {_hits()} SELECT h20.node AS url, round(h20.x, 8) AS hub, round(a20.x, 8) AS authority FROM h20 JOIN a20 ON h20.node = a20.node",
    "assoc_terms": _related("association"),
    "metric_terms": _related("metric"),
    "scalar_terms": _related("scalar"),
    "cluster_run": _cluster_run(),
    "rocchio_identity": _rocchio(),
    "crawl_audit": f"""
WITH {_INDEX}, p AS (SELECT count(*) AS pages, count(*) FILTER (coalesce(strlen(text), 0) = 0) AS empty_pages, count(*) FILTER (strlen(text) BETWEEN 1 AND 99) AS small_pages FROM docs),
g AS (SELECT count(*) FILTER (src IS NOT NULL AND dst IS NOT NULL) AS edges, count(*) FILTER (src IS NULL OR dst IS NULL) AS corrupt_edges, count(DISTINCT CASE WHEN dst IS NOT NULL THEN src END) AS unique_sources FROM web_graph)
SELECT pages, empty_pages, small_pages, edges, corrupt_edges, unique_sources, pages < 100000 AS too_few_pages, edges > 0 AND unique_sources < 0.5 * pages AS low_coverage FROM p, g""",
    "crawl_frontier": f"""
WITH RECURSIVE {_ENDS.split("sided")[0].rstrip().rstrip(",")},
seeds(url) AS (VALUES ('https://www.pridewatch.example/'), ('https://www.pridewatch.example/atlas')),
pg AS (SELECT lower(url) AS url FROM (SELECT 'page_' || id || '.txt', min({_strip('url')}) AS url FROM url_mapping WHERE id IS NOT NULL AND url IS NOT NULL GROUP BY id) UNION SELECT url FROM seeds),
l AS (SELECT DISTINCT src, dst FROM ends JOIN pg ON pg.url = src WHERE dst IS NOT NULL),
walk AS (SELECT url, 0 AS level FROM seeds UNION SELECT dst, level + 1 FROM walk JOIN l ON l.src = walk.url WHERE level < 40)
SELECT url, min(level) AS level FROM walk GROUP BY url""",
    "p3_found": f"WITH {_ENDS} SELECT side, url FROM sided WHERE url IS NOT NULL GROUP BY side, url HAVING count(*) * 50 >= (SELECT count(*) FROM ends)",
    "p3_degrees": f"WITH {_ENDS} SELECT side, url, count(*) AS n_links, count(DISTINCT other) AS n_partners FROM sided WHERE url IS NOT NULL GROUP BY side, url",
}
SQL["result_overlap"] = f"""
WITH own AS (SELECT query_id, lower({_strip("url")}) AS url_key FROM ({SQL["search_hybrid"]})),
given AS (SELECT DISTINCT query_id, lower({_strip("url")}) AS url_key FROM search_results WHERE url IS NOT NULL)
SELECT g.query_id, count(*) AS stored, count(own.url_key) AS found FROM given g LEFT JOIN own ON own.query_id = g.query_id AND own.url_key = g.url_key GROUP BY g.query_id"""
SQL["search_loaded"] = SQL["search_hybrid"]
SQL["index_extended"] = SQL["postings_tf"]
_TOP_HITS = "SELECT CAST(row_number() OVER (ORDER BY round(x, 12) DESC, node) AS INTEGER) AS place, node AS url, round(x, 8) AS score FROM {0} ORDER BY round(x, 12) DESC, node LIMIT 5"
SQL["authorities_top"] = f"WITH {_hits()} {_TOP_HITS.format('a20')}"
SQL["hubs_top"] = f"WITH {_hits()} {_TOP_HITS.format('h20')}"
SQL["link_scores_saved"] = f"SELECT p.url, pagerank, hub, authority FROM ({SQL['pagerank']}) p JOIN ({SQL['hits']}) h ON p.url = h.url"
SQL["page_files"] = f"WITH {_INDEX} SELECT doc_id, replace(coalesce(text, ''), chr(65533), '') AS text FROM docs"
SQL["map_file"] = f"WITH {_INDEX} SELECT doc_id, url FROM urls"
SQL["edge_file"] = "SELECT src, dst FROM web_graph WHERE src IS NOT NULL AND dst IS NOT NULL"
SQL["crawl_state_file"] = f"""
WITH {_INDEX}, v AS (SELECT DISTINCT url FROM urls), f AS (SELECT DISTINCT dst AS url FROM web_graph WHERE src IS NOT NULL AND dst IS NOT NULL)
SELECT url, 'visited' AS state FROM v UNION ALL SELECT url, 'frontier' FROM f WHERE url NOT IN (SELECT url FROM v)"""
_ASKED_TEXT = rf"regexp_replace({_strip('query_text')}, '\s+', ' ', 'g')"
SQL["query_file"] = f"""
WITH k AS (SELECT DISTINCT query_id, section, {_ASKED_TEXT} AS q FROM query_set WHERE query_text IS NOT NULL AND section IS NOT NULL AND {_strip('query_text')} <> '')
SELECT row_number() OVER (ORDER BY section, query_id) AS query_id, section, q AS query_text FROM k"""
SQL["competitor_file"] = "SELECT DISTINCT CAST(query_id AS VARCHAR) AS query, 'stored' AS engine, '' AS title, url, '' AS snippet FROM search_results WHERE url IS NOT NULL AND query_id IS NOT NULL"


def _expanded(measure: str) -> str:
    return f"""
near_{measure} AS ({_best(measure, 8)}),
sum_{measure} AS (SELECT s.query_id, b.term, sum(score * log10((SELECT CAST(count(*) AS DOUBLE) FROM urls) / df)) AS score FROM single s JOIN near_{measure} b USING (seed) JOIN dfs USING (term)
  WHERE NOT list_contains(w, b.term) AND len(b.term) >= 4 AND b.term NOT IN {_STOP} GROUP BY ALL),
add_{measure} AS (SELECT query_id, string_agg(term, ' ' ORDER BY place) AS added FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, term) AS place FROM sum_{measure}) WHERE place <= 3 GROUP BY query_id)"""


_MEASURES = ("association", "metric", "scalar")
SQL["expand_cluster"] = rf"""
WITH {_INDEX}, {_ASKED},
named AS (SELECT query_id, query_text, coalesce(list_filter(string_split(lower(trim(regexp_replace(query_text, '\s+', ' ', 'g'))), ' '), lambda x: x <> '' AND x NOT IN {_STOP}), []) AS w FROM asked),
single AS (SELECT query_id, w, unnest(w) AS seed FROM named), seeds AS (SELECT DISTINCT seed FROM single), {_RELATED}, {",".join(map(_expanded, _MEASURES))}
SELECT n.query_id, {", ".join(f"CASE WHEN len(w) = 0 THEN query_text ELSE query_text || ' ' || coalesce(a_{m}.added, '') END AS {m}" for m in _MEASURES)}
FROM named n {" ".join(f"LEFT JOIN add_{m} a_{m} ON a_{m}.query_id = n.query_id" for m in _MEASURES)}"""
