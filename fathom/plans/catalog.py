"""Every registered query of the engine, with its SQL twin for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text, url
from fathom.functions.tables import DOMAIN_TAGS, STOPWORDS, TAXONOMY, TRACKING_PARAMS, URL_STOP_TOKENS
from fathom.operators import crawl, library, search, store, tags
from fathom.sources import adapters as A
from fathom.streaming import changes

#: The stand-in vectors are noise around 0: their ranking needs a lower floor than the default.
WEIGHTS = search.Weights(floor=0.1)
NOW_MS = 1_707_000_000_000

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# --- pieces of SQL


def tok(t: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^a-z0-9]+'), lambda x: length(x) >= 2))"


def norm(v: str) -> str:
    return f"list_transform({v}, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform({v}, lambda y: CAST(y AS DOUBLE) * y))))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def decoded(t: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return t


_tracks = "(?i)^(utm_.*|" + "|".join(TRACKING_PARAMS) + ")$"
PAGES = f"""
urls AS (
    SELECT page_id, url, html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
           regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)), '^www\\.', '') AS host,
           regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages
),
canon AS (
    SELECT *, scheme || '://' || host || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 AND path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END ||
        CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_transform(list_sort(kept), lambda x: x.p), '&') ELSE '' END AS canonical_url
    FROM (SELECT *, list_transform(list_filter(list_zip(string_split(query, '&'), range(1000)), lambda z: z[1] IS NOT NULL AND z[1] <> '' AND NOT regexp_matches(split_part(z[1], '=', 1), '{_tracks}')),
        lambda z: {{'k': split_part(z[1], '=', 1), 'i': z[2], 'p': CASE WHEN contains(z[1], '=') THEN z[1] ELSE z[1] || '=' END}}) AS kept FROM urls)
),
records AS (
    SELECT page_id, CAST(page_id AS VARCHAR) AS id, url, canonical_url, host,
        coalesce(nullif(trim({decoded("regexp_extract(left(html, 200000), '(?is)<title[^>]*>(.*?)</title>', 1)")}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), ''), '') AS title,
        'Library / ' || regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) || ' / ' || host AS folder_path,
        1700000000000 + page_id * 86400000 AS date_added,
        list_filter(list_transform(regexp_extract_all(html, '(?is)<h[12]\\b[^>]*>(.*?)</h[12]>', 1), lambda x: trim(regexp_replace({decoded("regexp_replace(x, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))), lambda x: x <> '') AS headings,
        ['tag ' || regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1)] AS tags,
        CASE page_id % 4 WHEN 0 THEN translate(title, '{A.LOWER}', '{A.UPPER}') WHEN 1 THEN 'On ' || title END AS og_title,
        CASE WHEN page_id % 3 <> 2 THEN 'Notes and links on the ' || regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) || ' pages' END AS meta_description,
        CASE WHEN page_id % 5 < 2 THEN 'The ' || host END AS site_name,
        CASE WHEN page_id % 2 = 0 THEN 'Going to the town with ' || title END AS excerpt,
        CASE WHEN page_id % 6 = 0 THEN ['topic of the ' || regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1)] ELSE [] END AS learned_tags,
        CASE WHEN page_id % 13 = 0 THEN 'dead' WHEN page_id % 5 = 0 THEN 'pending' ELSE 'full' END AS status
    FROM canon
)"""
ASKED = f"asked AS (SELECT *, {tok('text')} AS q, lower(trim(text)) AS phrase FROM (VALUES (0, 'the and', 0), (1, 'of the', 1), (2, 'to', 2), (3, 'ing tion', 3)) t(query_id, text, vec_id))"


def _cover(tokens: str) -> str:
    each = f"CASE WHEN list_contains({tokens}, w) THEN 1.0::DOUBLE WHEN len(list_filter({tokens}, lambda t: starts_with(t, w))) > 0 THEN 0.8::DOUBLE ELSE 0::DOUBLE END"
    return f"(list_sum(list_transform(q, lambda w: {each})) / len(q))"


LEXICAL = f"""
tokens AS (
    SELECT *, {tok("title")} AS tt, {tok("array_to_string(list_concat(tags, learned_tags), ' ')")} AS gt, {tok("CASE WHEN canonical_url <> '' THEN canonical_url ELSE url END")} AS ut,
           {tok("folder_path")} AS ft, {tok("concat_ws(' ', meta_description, site_name, array_to_string(headings, ' '))")} AS dt FROM records
),
parts AS (
    SELECT query_id, id, CASE WHEN len(q) >= 2 AND length(phrase) >= 2 AND contains(lower(title), phrase) THEN 1.0::DOUBLE ELSE 0::DOUBLE END AS p,
           {_cover("tt")} * 0.9::DOUBLE AS t, {_cover("gt")} * 0.65::DOUBLE AS g, {_cover("ut")} * 0.55::DOUBLE AS u, {_cover("ft")} * 0.4::DOUBLE AS f, {_cover("dt")} * 0.35::DOUBLE AS d
    FROM tokens CROSS JOIN asked WHERE len(q) > 0
),
best AS (SELECT *, greatest(p, t, g, u, f, d) AS b, (p > 0)::INT + (t > 0)::INT + (g > 0)::INT + (u > 0)::INT + (f > 0)::INT + (d > 0)::INT AS n FROM parts),
lex AS (
    SELECT query_id, id, least(1.0::DOUBLE, b + 0.05::DOUBLE * (n - 1)) AS lex,
           CASE b WHEN p THEN 'title' WHEN t THEN 'title' WHEN g THEN 'tag' WHEN u THEN 'url' WHEN f THEN 'folder' ELSE 'description' END AS lex_reason FROM best WHERE b > 0
)"""
COSINES = f"""
qv AS (SELECT a.query_id, {norm("e.embedding")} AS v FROM asked a JOIN embeddings e ON e.vec_id = a.vec_id),
cosines AS (SELECT query_id, vec_id, CAST(vec_id AS VARCHAR) AS id, round({dot("embedding", "v")}, 6) AS cos FROM embeddings CROSS JOIN qv)"""
SEMANTIC = f"""
{COSINES},
above AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank, max(cos) OVER (PARTITION BY query_id) AS top FROM cosines WHERE cos > 0.1),
sem AS (SELECT query_id, id, cos, rank, 0.6::DOUBLE * (6.0::DOUBLE / (5.0::DOUBLE + rank)) + 0.4::DOUBLE * CASE WHEN top - 0.1::DOUBLE <= 0 THEN 0 ELSE least(1, greatest(0, (cos - 0.1::DOUBLE) / (top - 0.1::DOUBLE))) END AS sem FROM above)"""
FUSED = """
fused AS (
    SELECT coalesce(l.query_id, s.query_id) AS query_id, coalesce(l.id, s.id) AS id, coalesce(lex, 0) AS lex, coalesce(sem, 0) AS sem, coalesce(lex_reason, 'title') AS lex_reason
    FROM lex l FULL JOIN (SELECT * FROM sem WHERE id IN (SELECT id FROM records)) s ON l.query_id = s.query_id AND l.id = s.id
),
scored AS (
    SELECT query_id, id, round(0.55::DOUBLE * lex + 0.45::DOUBLE * sem, 6) AS score,
           CASE WHEN lex >= 0.45 AND 0.55::DOUBLE * lex >= 0.45::DOUBLE * sem THEN lex_reason ELSE 'semantic' END AS reason FROM fused
),
hits AS (
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score, reason FROM (
        SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(title), title, s.id) AS rank FROM scored s JOIN records r ON s.id = r.id WHERE score >= 0.05
    ) WHERE rank <= 150
)"""
HYBRID = f"WITH {PAGES}, {ASKED}, {LEXICAL}, {SEMANTIC}, {FUSED}"
CLICKS = f"""
clicks AS (
    SELECT event_id AS click_id, q AS query, {tok("q")} AS tokens, CAST(user_id AS VARCHAR) AS record_id, epoch_us(ts) // 1000 AS ts, 1 + event_id % 20 AS rank, event_type <> 'error' AS sat
    FROM (SELECT *, ['the and', 'of the', 'to', 'the ing'][1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 4] AS q FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error'))
)"""
SIGNALS = f"""
weights AS (
    SELECT array_to_string(list_sort(tokens), ' ') AS qn, any_value(tokens) AS tokens, record_id,
        sum(CASE WHEN rank <= 3 THEN 1::DOUBLE ELSE least(1.5::DOUBLE, 1 + 0.05::DOUBLE * (rank - 3)) END * CASE WHEN {NOW_MS} - ts <= 0 THEN 1::DOUBLE ELSE pow(0.5::DOUBLE, ({NOW_MS} - ts)::DOUBLE / 2592000000) END) AS w
    FROM clicks WHERE sat AND record_id <> '' AND rank >= 1 GROUP BY 1, record_id
),
likes AS (
    SELECT query_id, record_id, w, CASE WHEN array_to_string(list_sort(q), ' ') = qn THEN 1::DOUBLE
        ELSE len(list_intersect(q, tokens))::DOUBLE / len(list_distinct(list_concat(q, tokens))) END AS s FROM weights CROSS JOIN asked
),
signals AS (SELECT query_id, record_id AS id, round(least(1.1::DOUBLE, ln(1 + sum(s * w))), 6) AS signal FROM likes WHERE s >= 0.5 GROUP BY query_id, record_id)"""


# --- scalars


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(list_sort(t), ' ')) AS tokens FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    t = A.table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens"))


@query(f"WITH {PAGES} SELECT page_id, canonical_url AS canonical, host AS domain, CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS registrable, scheme || '://' || regexp_extract(lower(url), '^[^:]+://([^/?#]+)', 1) AS origin FROM canon")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return A.table(spark, d, "pages").select("page_id", url.canonical(u).alias("canonical"), url.domain(u).alias("domain"), url.registrable(url.domain(u)).alias("registrable"), url.origin(u).alias("origin"))


@query(
    f"WITH {PAGES}, t AS (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1) || path), '[/\\-_.]+'), lambda x: x <> '' AND NOT list_contains({list(URL_STOP_TOKENS)}, x) "
    "AND NOT regexp_full_match(x, '[0-9]+') AND NOT (length(x) >= 8 AND regexp_full_match(x, '[0-9a-f]+')) AND NOT (length(x) >= 10 AND regexp_matches(x, '[0-9]')))) AS t FROM canon) SELECT page_id, array_to_string(list_sort(t), ' ') AS tokens FROM t"
)
def url_tokens(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(url.tokens(F.col("url"))), " ").alias("tokens"))


@query(
    f"WITH {PAGES} SELECT page_id, lpad(lower(hex(CAST(list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], list_transform(string_split(title, ''), lambda c: CAST(unicode(c) AS HUGEINT))), "
    "lambda h, u: (xor(h, u) * 1099511628211) % 18446744073709551616) AS UBIGINT))), 16, '0') AS content_hash FROM records WHERE title <> ''"
)
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return A.records(spark, d).where("title <> ''").select(F.col("id").cast("long").alias("page_id"), text.content_hash(F.col("title")).alias("content_hash"))


@query(
    f"WITH {PAGES} SELECT page_id, nullif(title, '') AS title, CASE WHEN page_id % 3 = 0 THEN 'Notes & links ' || page_id END AS og_title, "
    "CASE page_id % 4 WHEN 1 THEN 'On <' || page_id || '>' WHEN 2 THEN 'plain ' || page_id END AS description, CASE WHEN page_id % 5 = 0 THEN 'Site ' || (page_id % 7) END AS site, "
    "CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN page_id % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS n_links FROM records"
)
def signals_regex(spark: SparkSession, d: str) -> DataFrame:
    return library.signals(A.dressed_pages(spark, d))


def composite_sql(rows: str) -> str:
    """CTEs up to `composed` (id, composite_text): the seven sections of each row, parts said before left out."""
    parts = [(0, "title"), (0, "og_title"), (1, "meta_description"), (2, "site_name"), (2, "host"), (3, "headings[1]"), (4, "excerpt"), (5, "us"), (6, "folder_path")]
    listed = ", ".join(f"{{'s': {i}, 'p': trim(coalesce({p}, ''))}}" for i, p in parts)
    return (
        f"t AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1) || path), '[/\\-_.]+'), lambda x: x <> '' AND NOT list_contains({list(URL_STOP_TOKENS)}, x) "
        f"AND NOT regexp_full_match(x, '[0-9]+') AND NOT (length(x) >= 8 AND regexp_full_match(x, '[0-9a-f]+')) AND NOT (length(x) >= 10 AND regexp_matches(x, '[0-9]'))) AS ut FROM (SELECT r.*, c.path FROM {rows} r JOIN canon c USING (page_id))), "
        "u AS (SELECT *, array_to_string(list_filter(list_transform(range(1, len(ut) + 1), lambda i: CASE WHEN list_position(ut, ut[i]) = i THEN ut[i] END), lambda x: x IS NOT NULL), ' ') AS us FROM t), "
        f"p AS (SELECT id, list_filter([{listed}], lambda x: x.p <> '') AS p FROM u), "
        "k AS (SELECT id, list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN list_position(list_transform(p, lambda y: lower(y.p)), lower(p[i].p)) = i THEN p[i] END), lambda x: x IS NOT NULL) AS k FROM p), "
        "composed AS (SELECT id, left(array_to_string(list_filter(list_transform(range(7), lambda s: array_to_string(list_transform(list_filter(k, lambda y: y.s = s), lambda y: y.p), ' ')), lambda x: x <> ''), chr(10)), 2000) AS composite_text FROM k)"
    )


@query(f"WITH {PAGES}, {composite_sql('records')} SELECT id, composite_text FROM composed")
def composite_text(spark: SparkSession, d: str) -> DataFrame:
    return library.with_composite(A.records(spark, d)).select("id", "composite_text")


# --- search


@query(f"WITH {PAGES}, {ASKED}, {LEXICAL} SELECT CAST(query_id AS BIGINT) AS query_id, id, round(lex, 6) AS lex, lex_reason FROM lex")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return search.lexical(A.records(spark, d), A.queries(spark, d)).select("query_id", "id", F.round("lex", 6).alias("lex"), "lex_reason")


@query(f"WITH {ASKED}, {COSINES} SELECT * FROM (SELECT CAST(query_id AS BIGINT) AS query_id, id, cos, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS INTEGER) AS rank FROM cosines) WHERE rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(A.vectors(spark, d), A.query_vectors(spark, d), 10)


@query(f"WITH {ASKED}, {SEMANTIC} SELECT CAST(query_id AS BIGINT) AS query_id, id, cos, CAST(rank AS INTEGER) AS rank, round(sem, 6) AS sem FROM sem")
def semantic_rank(spark: SparkSession, d: str) -> DataFrame:
    return search.semantic(A.vectors(spark, d), A.query_vectors(spark, d), WEIGHTS).withColumn("sem", F.round("sem", 6))


@query(f"{HYBRID} SELECT CAST(query_id AS BIGINT) AS query_id, rank, id, score, reason FROM hits")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(A.records(spark, d), A.vectors(spark, d), A.query_vectors(spark, d), WEIGHTS)


@query(f"WITH {ASKED}, {CLICKS}, {SIGNALS} SELECT CAST(query_id AS BIGINT) AS query_id, id, signal FROM signals")
def click_signals(spark: SparkSession, d: str) -> DataFrame:
    return search.click_signals(A.clicks(spark, d), A.queries(spark, d), NOW_MS)


@query(
    f"{HYBRID}, {CLICKS}, {SIGNALS}, boosted AS (SELECT h.query_id, h.id, h.reason, round(h.score * (1 + 0.25::DOUBLE * coalesce(signal, 0)), 6) AS score FROM hits h LEFT JOIN signals s ON h.query_id = s.query_id AND h.id = s.id) "
    "SELECT CAST(query_id AS BIGINT) AS query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(title), title, b.id) AS INTEGER) AS rank, b.id, score, reason FROM boosted b JOIN records r ON b.id = r.id"
)
def boosted_search(spark: SparkSession, d: str) -> DataFrame:
    hits = search.hybrid(A.records(spark, d), A.vectors(spark, d), A.query_vectors(spark, d), WEIGHTS)
    return search.boosted(hits, search.click_signals(A.clicks(spark, d), A.queries(spark, d), NOW_MS), A.records(spark, d))


_BROWSE = f"WITH {PAGES}, {CLICKS}, o AS (SELECT record_id AS id, max(ts) AS opened FROM clicks GROUP BY record_id) SELECT r.id, title, folder_path, greatest(date_added, coalesce(opened, 0)) AS activity FROM records r LEFT JOIN o ON r.id = o.id"


@query(_BROWSE)
def browse_recent(spark: SparkSession, d: str) -> DataFrame:
    return search.browse(A.records(spark, d), A.clicks(spark, d))


@query(_BROWSE + " WHERE folder_path = 'Library / en' OR starts_with(folder_path, 'Library / en / ')")
def browse_subtree(spark: SparkSession, d: str) -> DataFrame:
    return search.browse(A.records(spark, d), A.clicks(spark, d), "name", "Library / en")


@query(f"WITH {PAGES} SELECT DISTINCT folder_path FROM records WHERE folder_path <> ''")
def folder_paths(spark: SparkSession, d: str) -> DataFrame:
    return search.folder_paths(A.records(spark, d))


@query(f"WITH {CLICKS} SELECT record_id AS id, max(ts) AS opened FROM clicks GROUP BY record_id")
def last_opened(spark: SparkSession, d: str) -> DataFrame:
    return search.last_opened(A.clicks(spark, d))


def _marked(t: str) -> str:
    e = f"regexp_replace({t}, '(?i)\\b((?:' || array_to_string(q, '|') || ')[a-z0-9]*)', '\\1', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"replace(replace({e}, '', '<match>'), '', '</match>')"


@query(
    f"{HYBRID}, one AS (SELECT h.*, r.title, r.url, row_number() OVER (PARTITION BY h.query_id, r.url ORDER BY h.rank) AS n FROM hits h JOIN records r ON h.id = r.id), "
    "placed AS (SELECT o.*, a.q, row_number() OVER (PARTITION BY o.query_id ORDER BY rank) AS place FROM one o JOIN asked a ON a.query_id = o.query_id WHERE n = 1) "
    f"SELECT CAST(query_id AS BIGINT) AS query_id, CAST(place AS INTEGER) AS place, id, {_marked('''CASE WHEN title <> '' THEN title ELSE url END''')} || ' <dim>- </dim><url>' || replace(url, '&', '&amp;') || '</url>' AS content FROM placed WHERE place <= 6"
)
def suggestions(spark: SparkSession, d: str) -> DataFrame:
    hits = search.hybrid(A.records(spark, d), A.vectors(spark, d), A.query_vectors(spark, d), WEIGHTS)
    return search.suggestions(hits, A.records(spark, d), A.queries(spark, d))


@query(f"WITH {PAGES} SELECT id, title, url, folder_path, date_added, left(coalesce(meta_description, excerpt), 240) AS description, array_to_string(list_concat(tags, learned_tags), ',') AS tags, status = 'dead' AS dead FROM records")
def hit_rows(spark: SparkSession, d: str) -> DataFrame:
    return search.hit_row(A.records(spark, d)).withColumn("tags", F.array_join("tags", ","))


def _expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, ["/en/", "news"], 5) for q in range(4)], "query_id long, expect array<string>, k int")


@query(
    f"{HYBRID}, firsts AS (SELECT h.query_id, min(rank) AS first FROM hits h JOIN records r ON h.id = r.id WHERE contains(lower(url), '/en/') OR contains(lower(url), 'news') GROUP BY h.query_id) "
    "SELECT count(*) AS queries, round(avg(CASE WHEN first <= 5 THEN 1::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(1::DOUBLE / first, 0)), 6) AS mrr FROM asked a LEFT JOIN firsts f ON a.query_id = f.query_id"
)
def eval_hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    hits = search.hybrid(A.records(spark, d), A.vectors(spark, d), A.query_vectors(spark, d), WEIGHTS)
    return search.evaluate(hits, _expected(spark), A.records(spark, d), A.queries(spark, d))


@query(
    f"WITH {PAGES}, {ASKED}, {LEXICAL}, {SEMANTIC}, grid AS (SELECT * FROM (VALUES (0.45::DOUBLE), (0.55::DOUBLE), (0.65::DOUBLE)) a(l), (VALUES (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE), (1::DOUBLE)) b(b), "
    "(VALUES (2::DOUBLE), (5::DOUBLE), (10::DOUBLE), (15::DOUBLE)) s(s)), "
    "pool AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.id, y.id) AS id, lex, cos, y.rank AS place, top FROM lex x FULL JOIN above y ON x.query_id = y.query_id AND x.id = y.id), "
    "each AS (SELECT l, b, s, query_id, r.id, title, url, round(l * coalesce(lex, 0) + (1 - l) * CASE WHEN cos IS NULL THEN 0 ELSE b * (s + 1) / (s + place) "
    "+ (1 - b) * CASE WHEN top - 0.1::DOUBLE <= 0 THEN 0 ELSE least(1, greatest(0, (cos - 0.1::DOUBLE) / (top - 0.1::DOUBLE))) END END, 6) AS score FROM pool p JOIN records r ON p.id = r.id CROSS JOIN grid), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY l, b, s, query_id ORDER BY score DESC, lower(title), title, id) AS n FROM each WHERE score >= 0.05), "
    "firsts AS (SELECT l, b, s, query_id, min(n) AS first FROM placed WHERE n <= 150 AND (contains(lower(url), '/en/') OR contains(lower(url), 'news')) GROUP BY ALL) "
    "SELECT g.l AS lexical, g.b AS blend, g.s AS sharpness, count(*) FILTER (first <= 5) AS hits, round(avg(coalesce(1::DOUBLE / first, 0)), 6) AS mrr FROM grid g CROSS JOIN asked a "
    "LEFT JOIN firsts f ON f.l = g.l AND f.b = g.b AND f.s = g.s AND f.query_id = a.query_id GROUP BY ALL ORDER BY hits DESC, mrr DESC, lexical, blend, sharpness LIMIT 8"
)
def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """48 weight combinations as one batch: each (query, combination) is a query of its own in one plan."""
    from fathom.operators.sweep import sweep

    return sweep(A.records(spark, d), A.vectors(spark, d), A.query_vectors(spark, d), _expected(spark), WEIGHTS.floor)


# --- store, ingest, folders


@query(f"WITH {PAGES}, old AS (SELECT id, CASE WHEN page_id % 7 = 0 THEN title || ' old' ELSE title END AS title FROM records WHERE page_id % 10 <> 0 UNION ALL SELECT CAST(page_id + 1000000 AS VARCHAR), title FROM records WHERE page_id < 10) "
       "SELECT coalesce(r.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'created' WHEN r.id IS NULL THEN 'stale' WHEN r.title = o.title THEN 'unchanged' ELSE 'updated' END AS action FROM records r FULL JOIN old o ON r.id = o.id")  # fmt: skip
def ingest_diff(spark: SparkSession, d: str) -> DataFrame:
    return library.diff(A.records(spark, d), A.existing_records(spark, d))


@query(f"WITH {PAGES} SELECT count(*) FILTER (page_id % 10 = 0) AS created, count(*) FILTER (page_id % 10 <> 0 AND page_id % 7 = 0) AS updated, count(*) FILTER (page_id < 10) AS removed_stale FROM records")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return library.summary(library.diff(A.records(spark, d), A.existing_records(spark, d)))


@query(f"WITH {PAGES} SELECT CAST(page_id + 1000000 AS VARCHAR) AS id FROM records WHERE page_id < 10")
def stale_delete(spark: SparkSession, d: str) -> DataFrame:
    return store.delete(A.existing_records(spark, d), A.records(spark, d)).select("id")


@query(f"WITH {PAGES} SELECT id, title FROM records UNION ALL SELECT CAST(page_id + 1000000 AS VARCHAR), title FROM records WHERE page_id < 10")
def bulk_upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(A.existing_records(spark, d), A.records(spark, d)).select("id", "title")


@query(f"WITH {CLICKS} SELECT click_id, query, record_id, ts FROM clicks ORDER BY click_id DESC LIMIT 2000")
def click_retention(spark: SparkSession, d: str) -> DataFrame:
    return store.newest(A.clicks(spark, d), "click_id").select("click_id", "query", "record_id", "ts")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id % 11 <> 0")
def vector_load(spark: SparkSession, d: str) -> DataFrame:
    return store.load_vectors(A.vectors(spark, d), A.CURRENT).select("vec_id", F.size("vector").alias("dim"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE vec_id % 11 = 0")
def stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    return A.vectors(spark, d).where(store.stale(F.col("model_version"), A.CURRENT, F.col("id"))).select("id")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    region, nation, customer = (A.table(spark, d, t) for t in ("region", "nation", "customer"))
    none = F.lit(None).cast("string")
    return (
        spark.range(1).select(F.lit("root").alias("id"), none.alias("parent_id"), F.lit("").alias("title"), none.alias("url"))
        .unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("title"), none.alias("url")))
        .unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"), none.alias("url")))
        .unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("title"), F.lit("https://x.example/").alias("url")))
    )


@query(
    "WITH l AS (SELECT n_nationkey, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT 'n' || n_nationkey AS id, n FROM l "
    "UNION ALL SELECT 'r' || n_regionkey, CAST(sum(n) AS BIGINT) FROM l GROUP BY n_regionkey UNION ALL SELECT 'root', CAST(sum(n) AS BIGINT) FROM l"
)
def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    return library.folder_counts(_tree(spark, d))


@query("SELECT 'c' || c_custkey AS id, r_name || ' / ' || n_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 1")
def tree_flatten(spark: SparkSession, d: str) -> DataFrame:
    return library.flatten(_tree(spark, d), ["r1"]).where("is_leaf").select("id", "path")


@query(
    f"WITH {PAGES} SELECT count(*) AS records, count(*) FILTER (status = 'full') AS \"full\", count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'dead') AS dead, count(*) FILTER (status = 'meta_only') AS meta_only, count(*) FILTER (status = 'baseline') AS baseline, "
    "count(meta_description) AS with_description, count(excerpt) AS with_excerpt, count(*) FILTER (len(tags) > 0) AS tagged, count(*) FILTER (len(learned_tags) > 0) AS learned, count(*) FILTER (len(headings) > 0) AS with_headings, count(*) FILTER (page_id IN (SELECT vec_id FROM embeddings)) AS embedded FROM records"
)
def corpus_health(spark: SparkSession, d: str) -> DataFrame:
    return library.health(A.records(spark, d), A.vectors(spark, d))


# --- tags and topics

_HOSTS = {f"site{i}.example.{e}": ("dev-docs", "news") if i % 2 else ("video",) for i in range(30) for e in ("com", "org")} | {"example.com": ("reference-wiki",), "example.net": ("forums",)}


@query(
    f"WITH {PAGES}, h(host, tags) AS (VALUES {', '.join(f'''('{h}', '{','.join(t)}')''' for h, t in _HOSTS.items())}) "
    "SELECT r.id, coalesce(a.tags, b.tags, '') AS tags FROM records r LEFT JOIN h a ON a.host = r.host LEFT JOIN h b ON b.host = array_to_string(string_split(r.host, '.')[-2:], '.')"
)
def heuristic_tags(spark: SparkSession, d: str) -> DataFrame:
    return tags.host_tags(A.records(spark, d), _HOSTS).select("id", F.array_join("heuristic", ",").alias("tags"))


def _label_tags(spark: SparkSession, d: str) -> DataFrame:
    c = tags.centroids(A.vectors(spark, d), "label")
    return c.select(F.concat(F.lit("label "), "cluster").alias("tag"), F.col("cluster").alias("ordinal"), F.col("centroid").alias("vector"))


_CENTROIDS = f"""
sums AS (SELECT label, d, sum(CAST(x AS DOUBLE)) AS s FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings) GROUP BY label, d),
means AS (SELECT label, list(s ORDER BY d) AS v FROM sums GROUP BY label),
centroids AS (SELECT label, list_transform({norm("v")}, lambda x: round(x, 4)) AS c FROM means)"""


@query(
    f"WITH {_CENTROIDS}, s AS (SELECT CAST(vec_id AS VARCHAR) AS id, 'label ' || c.label AS tag, round({dot(norm('embedding'), norm('c.c'))}, 6) AS score, c.label FROM embeddings e CROSS JOIN centroids c) "
    "SELECT id, tag, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS place FROM s WHERE score >= 0.1) WHERE place <= 2"
)
def zero_shot_tags(spark: SparkSession, d: str) -> DataFrame:
    return tags.zero_shot(A.vectors(spark, d), _label_tags(spark, d), threshold=0.1)


@query(f"WITH {_CENTROIDS} SELECT e.label AS cluster, count(*) AS size, round(avg({dot(norm('embedding'), 'c.c')}), 5) AS cohesion FROM embeddings e JOIN centroids c ON e.label = c.label GROUP BY e.label")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return tags.cluster_stats(A.vectors(spark, d), "label")


@query(
    f"WITH {_CENTROIDS}, s AS (SELECT CAST(vec_id AS VARCHAR) AS id, c.label AS cluster, round({dot(norm('embedding'), 'c.c')}, 6) AS cos FROM embeddings e CROSS JOIN centroids c) "
    "SELECT id, cluster, cos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, cluster) AS n FROM s) WHERE n = 1 AND cos >= 0.1"
)
def nearest_topic(spark: SparkSession, d: str) -> DataFrame:
    return tags.nearest_topic(A.vectors(spark, d), tags.centroids(A.vectors(spark, d), "label"), at_least=0.1)


_TERMS = f"""
t AS (SELECT source, list_filter({tok("text")}, lambda x: length(x) >= 3 AND NOT list_contains({list(dict.fromkeys(STOPWORDS))}, x) AND NOT regexp_full_match(x, '[0-9]+')) AS t FROM documents),
sizes AS (SELECT source, count(*) AS n FROM t GROUP BY source),
dfc AS (SELECT source, term, count(*) AS df_c FROM (SELECT source, unnest(t) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, sum(df_c) AS df FROM dfc GROUP BY term)"""


def _source_docs(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select(F.col("source").alias("cluster"), text.tokenize(F.col("text")).alias("tokens"))


@query(
    f"WITH {_TERMS} SELECT dfc.source AS cluster, dfc.term, df_c, round(df_c::DOUBLE / greatest(n, 1) * ln(1 + (SELECT avg(n) FROM sizes) / df), 6) AS score FROM dfc JOIN df ON dfc.term = df.term JOIN sizes ON sizes.source = dfc.source "
    "WHERE df_c >= greatest(2, ceil(0.15::DOUBLE * n))"
)
def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    return tags.topic_terms(_source_docs(spark, d))


@query()
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").select((F.regexp_extract("source", "[0-9]+", 0).cast("long")).alias("cluster"), text.tokenize(F.col("text")).alias("tokens"))
    return tags.label_clusters(tags.topic_terms(docs), docs)


@query()
def learned_topics(spark: SparkSession, d: str) -> DataFrame:
    return tags.learn_topics(A.vectors(spark, d))


@query(f"SELECT * FROM (VALUES {', '.join('({}, {}, {})'.format(i, *(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in t[:2])) for i, t in enumerate(TAXONOMY))}) t(ordinal, id, label)")
def tag_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return tags.taxonomy(spark).select("ordinal", "id", "label")


@query(f"SELECT h AS host FROM (VALUES {', '.join(f'''('{h}')''' for h in DOMAIN_TAGS)}) t(h) WHERE false")
def broken_host_tags(spark: SparkSession, d: str) -> DataFrame:
    """Hosts with a tag that the taxonomy lacks: none."""
    rows = spark.createDataFrame([(h, t) for h, ts in DOMAIN_TAGS.items() for t in ts], "host string, id string")
    return rows.join(tags.taxonomy(spark).select("id"), "id", "left_anti").select("host")


# --- crawl

_KINDS = """
o AS (SELECT event_id, CAST(user_id AS VARCHAR) AS id, event_id % 4 AS attempts, event_type, epoch_us(ts) // 1000 AS ts FROM events),
k AS (SELECT *, CASE WHEN event_type = 'error' AND attempts + 1 < 3 THEN 'deferred' WHEN event_type IN ('error', 'signup') THEN 'failed' ELSE 'done' END AS kind FROM o)"""


@query(f"WITH {_KINDS} SELECT event_id, id, kind, CAST(CASE WHEN kind = 'deferred' THEN ts + 30000 * pow(4, attempts) END AS BIGINT) AS not_before FROM k")
def queue_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return crawl.classify(A.outcomes(spark, d)).select("event_id", "id", "kind", "not_before")


@query(f"WITH {_KINDS} SELECT count(*) FILTER (kind = 'done') AS fetched, count(*) FILTER (kind = 'failed') AS failed, count(*) FILTER (kind = 'deferred') AS deferred FROM k")
def queue_counts(spark: SparkSession, d: str) -> DataFrame:
    return crawl.counts(crawl.classify(A.outcomes(spark, d)))


@query(
    f"WITH {PAGES}, w AS (SELECT id, lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) AS host, date_added FROM records), v AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY host ORDER BY date_added, id) / 2::DOUBLE) AS BIGINT) AS wave FROM w) "
    "SELECT id, host, wave, CAST(ceil(row_number() OVER (PARTITION BY wave ORDER BY date_added, id) / 6::DOUBLE) AS BIGINT) AS slot FROM v"
)
def crawl_waves(spark: SparkSession, d: str) -> DataFrame:
    return crawl.waves(A.records(spark, d))


@query(
    f"WITH {PAGES}, last AS (SELECT CAST(user_id AS VARCHAR) AS id, arg_max(CASE WHEN event_type IN ('error', 'signup') THEN 'dead' ELSE 'full' END, (ts, event_id)) AS s FROM events GROUP BY user_id) "
    "SELECT r.id, coalesce(l.s, r.status) AS status FROM records r LEFT JOIN last l ON r.id = l.id"
)
def outcome_merge(spark: SparkSession, d: str) -> DataFrame:
    return crawl.merge_outcome(A.records(spark, d), A.outcomes(spark, d)).select("id", "status")


# --- change streams, in batch form


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), "
    "s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) "
    'SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts) + INTERVAL 30 MINUTE) // 1000 AS end_ms, count(*) AS n FROM s GROUP BY user_id, s.n'
)
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.debounce(events, "user_id", quiet="30 minutes").select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


#: The row before a close in its tab's order is the open it belongs to, or there is none.
_BOUNCED = """
told AS (SELECT user_id, ts, event_type = 'click' AS opens, event_id FROM events WHERE event_type IN ('click', 'error')),
near AS (SELECT *, lag(opens) OVER w AS was_open, lag(event_id) OVER w AS click_id, lag(ts) OVER w AS opened FROM told WINDOW w AS (PARTITION BY user_id ORDER BY ts, NOT opens, event_id)),
bounced AS (SELECT click_id, opened, ts AS closed FROM near WHERE NOT opens AND was_open AND ts < opened + INTERVAL 2 HOUR)"""


@query(f"WITH {_BOUNCED} SELECT click_id, epoch_us(opened) // 1000 AS opened, epoch_us(closed) // 1000 AS closed FROM bounced")
def bounce_join(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select("event_id", "event_type", F.col("user_id").alias("tab"), F.col("ts").cast("timestamp").alias("ts"))
    opens = e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "tab", "ts")
    found = changes.bounces(opens, e.where("event_type = 'error'").select("tab", "ts"), "2 hours")
    return found.select("click_id", F.unix_millis("opened").alias("opened"), F.unix_millis("closed").alias("closed"))


@query(
    f"WITH {CLICKS}, {_BOUNCED} SELECT c.click_id, sat AND b.click_id IS NULL AS sat FROM clicks c LEFT JOIN bounced b ON b.click_id = c.click_id"
)
def bounce_marks(spark: SparkSession, d: str) -> DataFrame:
    return store.mark_unsatisfying(A.clicks(spark, d), bounce_join(spark, d)).select("click_id", "sat")


@query(
    f"WITH {PAGES}, last AS (SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS op, max(event_id) AS seq FROM events GROUP BY user_id) "
    "SELECT id, title FROM records WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, 'seq ' || seq FROM last WHERE op <> 'error'"
)
def cdc_apply(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("seq "), "event_id").alias("title"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "removed").otherwise("changed").alias("op"))
    return changes.apply_changes(A.records(spark, d).select("id", "title"), rows)
