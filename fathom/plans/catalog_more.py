"""Further registered queries: lookups, predicates, queue and icon rules, small scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text, url
from fathom.functions.tables import STOPWORDS, TAXONOMY
from fathom.operators import crawl, icons, library, search, store, tags
from fathom.plans.catalog import CLICKS, HYBRID, NOW_MS, PAGES, WEIGHTS, composite_sql, query, tok
from fathom.sources import adapters as A


@query(f"WITH {PAGES} SELECT id, title, url FROM records WHERE id = '7'")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return A.records(spark, d).where("id = '7'").select("id", "title", "url")


@query("SELECT count(*) AS n FROM pages")
def record_count(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").agg(F.count("*").alias("n"))


@query("SELECT page_id, length(html) > 0 AS has_body FROM pages")
def projected_scan(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", (F.length("html") > 0).alias("has_body"))


@query(f"WITH {PAGES} SELECT id FROM records WHERE status = 'pending'")
def pending_records(spark: SparkSession, d: str) -> DataFrame:
    return A.records(spark, d).where("status = 'pending'").select("id")


@query("SELECT event_id, event_type = 'error' AS retryable FROM events")
def retryable_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return A.outcomes(spark, d).select("event_id", F.coalesce(crawl.retryable(F.col("status"), F.col("detail")), F.lit(False)).alias("retryable"))


_QUEUE = "q AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(max(event_id % 4) AS INTEGER) AS attempts, max(CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 END) AS not_before FROM events GROUP BY user_id)"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return A.outcomes(spark, d).groupBy("id").agg(F.max("attempts").alias("attempts"), F.max(F.when(F.col("event_id") % 3 == 0, F.col("ts"))).alias("not_before"))


@query(f"WITH {_QUEUE} SELECT id, attempts FROM q WHERE not_before IS NULL OR not_before <= 1706500000000")
def due_items(spark: SparkSession, d: str) -> DataFrame:
    return crawl.due(_queue(spark, d), 1_706_500_000_000).select("id", "attempts")


@query(f"WITH {_QUEUE} SELECT min(coalesce(not_before, {NOW_MS})) AS next_due FROM q")
def next_due(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d).agg(F.min(F.coalesce("not_before", F.lit(NOW_MS))).alias("next_due"))


@query(f"WITH {PAGES}, {_QUEUE} SELECT id, attempts, not_before FROM q UNION ALL SELECT id, 0, NULL FROM records WHERE id NOT IN (SELECT id FROM q)")
def enqueue_new(spark: SparkSession, d: str) -> DataFrame:
    return crawl.enqueue(_queue(spark, d), A.records(spark, d))


@query(f"WITH {PAGES}, {_QUEUE} SELECT q.id, r.id IS NULL AS dropped FROM q LEFT JOIN records r ON q.id = r.id")
def queue_records(spark: SparkSession, d: str) -> DataFrame:
    known = A.records(spark, d).select("id", F.lit(True).alias("known"))
    return _queue(spark, d).join(known, "id", "left").select("id", F.col("known").isNull().alias("dropped"))


@query("SELECT event_id, CAST(30000 * pow(4, event_id % 4) AS BIGINT) AS delay_ms FROM events")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", crawl.backoff_ms(F.col("event_id") % 4 + 1).alias("delay_ms"))


_ICONS = "icons AS (SELECT DISTINCT 'https://' || regexp_extract(lower(url), '^[^:]+://([^/?#]+)', 1) AS origin FROM pages), held AS (SELECT origin, length(origin) % 3 = 0 AS has_icon, CAST(1 + length(origin) % 3 AS INTEGER) AS sync_version FROM icons WHERE length(origin) % 4 <> 0)"


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select(F.regexp_replace(url.origin(F.col("url")), "^http:", "https:").alias("origin")).distinct()


def _icons(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("origin")
    return _origins(spark, d).where(n % 4 != 0).select("origin", (n % 3 == 0).alias("has_icon"), (1 + n % 3).cast("int").alias("sync_version"), F.lit(None).cast("string").alias("declared_url"))


@query(f"WITH {_ICONS} SELECT i.origin FROM icons i LEFT JOIN held h ON i.origin = h.origin WHERE h.origin IS NULL OR (NOT has_icon AND sync_version < 3)")
def icon_attempts(spark: SparkSession, d: str) -> DataFrame:
    return crawl.icon_due(_icons(spark, d), _origins(spark, d).withColumn("declared", F.lit(None).cast("string"))).select("origin")


@query(f"WITH {_ICONS} SELECT count(*) AS total, count(*) FILTER (has_icon) AS has_bytes, count(*) FILTER (NOT has_icon) AS negative FROM held")
def icon_stats(spark: SparkSession, d: str) -> DataFrame:
    return icons.stats(_icons(spark, d))


@query("SELECT event_id, event_type <> 'error' AND 1 + event_id % 131073 <= 131072 AS valid FROM events")
def icon_validity(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "text/html").otherwise("image/png")
    return A.table(spark, d, "events").select("event_id", crawl.valid_icon(kind, 1 + F.col("event_id") % 131073).alias("valid"))


@query(
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'dead' WHEN event_type = 'signup' THEN 'baseline' WHEN event_type = 'view' THEN 'full' WHEN event_type = 'click' THEN 'meta_only' ELSE 'baseline' END AS status FROM events"
)
def fetch_statuses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_type")
    kind = F.when(k == "signup", "application/pdf").otherwise("text/html; charset=utf-8")
    status = crawl.fetch_status(k == "error", kind, k.isin("view", "click"), F.when(k == "view", "words").otherwise(""), F.lit(False))
    return A.table(spark, d, "events").select("event_id", status.alias("status"))


@query(f"WITH {PAGES}, t(id, label) AS (VALUES {', '.join('({}, {})'.format(*(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in t[:2])) for t in TAXONOMY)}), w AS (SELECT id AS record_id, unnest([tags[1], 'news']) AS tag FROM records) SELECT record_id, coalesce(label, tag) AS label FROM w LEFT JOIN t ON t.id = w.tag")
def tag_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d).select(F.col("id").alias("record_id"), F.explode(F.array(F.element_at("tags", 1), F.lit("news"))).alias("tag"))
    return rows.join(F.broadcast(tags.taxonomy(spark).select(F.col("id").alias("tag"), "label")), "tag", "left").select("record_id", F.coalesce("label", "tag").alias("label"))  # a fixed table


@query(f"WITH {PAGES}, {composite_sql('records')} SELECT id, coalesce(nullif(concat_ws(chr(10), nullif(title, ''), meta_description, site_name), ''), composite_text) AS tag_text FROM records JOIN composed USING (id)")
def tag_text(spark: SparkSession, d: str) -> DataFrame:
    records = library.with_composite(A.records(spark, d))
    return records.select("id", tags.tag_text(records).alias("tag_text"))


@query(
    f"WITH {PAGES}, t AS (SELECT id, list_filter({tok("concat_ws(' ', title, site_name, meta_description)")}, lambda x: length(x) >= 3 AND NOT list_contains({list(dict.fromkeys(STOPWORDS))}, x) AND NOT regexp_full_match(x, '[0-9]+')) AS t FROM records) "
    "SELECT id, array_to_string(list_sort(t), ' ') AS tokens FROM t"
)
def topic_doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    records = A.records(spark, d)
    return records.select("id", F.array_join(F.array_sort(tags.topic_tokens(tags.topic_text(records))), " ").alias("tokens"))


@query("SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:5], ' ')) AS head FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 5")
def first_words(spark: SparkSession, d: str) -> DataFrame:
    long = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) > 5
    return A.table(spark, d, "documents").where(long).select("doc_id", F.md5(text.cap_words(F.col("text"), 5)).alias("head"))


@query(f"WITH {HYBRID[5:].lstrip()} SELECT CAST(query_id AS BIGINT) AS query_id, rank, id FROM hits WHERE rank > 25 AND rank <= 50")
def second_page(spark: SparkSession, d: str) -> DataFrame:
    hits = search.hybrid(A.records(spark, d), A.vectors(spark, d), A.query_vectors(spark, d), WEIGHTS)
    return hits.where("rank > 25 AND rank <= 50").select("query_id", "rank", "id")


@query(f"{HYBRID} SELECT CAST(query_id AS BIGINT) AS query_id, rank FROM hits WHERE id = '5'")
def rank_of(spark: SparkSession, d: str) -> DataFrame:
    hits = search.hybrid(A.records(spark, d), A.vectors(spark, d), A.query_vectors(spark, d), WEIGHTS)
    return hits.where("id = '5'").select("query_id", "rank")


@query(f"WITH {PAGES} SELECT id, title FROM records WHERE contains(lower(title), 'the') ORDER BY page_id LIMIT 8")
def title_peek(spark: SparkSession, d: str) -> DataFrame:
    return A.records(spark, d).where(F.contains(F.lower("title"), F.lit("the"))).orderBy(F.col("id").cast("long")).limit(8).select("id", "title")


@query(f"WITH {CLICKS}, one AS (SELECT record_id, rank, click_id, row_number() OVER (PARTITION BY record_id ORDER BY click_id) AS n FROM clicks) SELECT record_id, click_id, rank FROM one WHERE n = 1")
def first_click(spark: SparkSession, d: str) -> DataFrame:
    first = A.clicks(spark, d).groupBy("record_id").agg(F.min_by(F.struct("click_id", "rank"), "click_id").alias("c"))
    return first.select("record_id", "c.click_id", "c.rank")


@query(f"WITH d AS (SELECT conv_id, turn, {tok('text')} AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn, array_to_string(list_sort(t), ' ') AS norm FROM d WHERE len(t) > 0")
def query_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    t = A.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.tokenize(F.col("text")).alias("t"))
    return t.where("size(t) > 0").select("conv_id", "turn", F.array_join(F.array_sort("t"), " ").alias("norm"))


_OWN = "own AS (SELECT r.* FROM records r WHERE page_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 11 <> 0))"


@query(f"WITH {PAGES}, {_OWN}, c AS (SELECT count(*) AS embedded, count(*) FILTER (status IN ('full', 'meta_only')) AS enriched FROM own) SELECT *, abs(embedded - 150) >= 25 OR abs(enriched - 120) >= 25 AS rebuild FROM c")
def topic_drift(spark: SparkSession, d: str) -> DataFrame:
    stored = {"stamp": tags.topics_stamp(A.CURRENT), "embedded": 150, "enriched": 120}
    return tags.drift(A.records(spark, d), A.vectors(spark, d), A.CURRENT, stored)


@query(f"WITH {PAGES}, {_OWN} SELECT id, title, CAST(len(embedding) AS INTEGER) AS dim FROM own JOIN embeddings ON vec_id = page_id")
def current_vectors(spark: SparkSession, d: str) -> DataFrame:
    return store.current_vectors(A.records(spark, d), A.vectors(spark, d), A.CURRENT).select("id", "title", F.size("vector").alias("dim"))


@query(
    "SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 3 = 0 THEN 'fixture@1' WHEN vec_id % 11 = 0 THEN 'fixture@0' ELSE 'fixture@1' END AS model_version, round(CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first FROM embeddings"
)
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A third of the vectors come again, under the current model and negated."""
    now = A.vectors(spark, d).select("id", "vec_id", "vector", "model_version")
    again = now.where(F.col("vec_id") % 3 == 0).withColumns({"vector": F.transform("vector", lambda x: -x), "model_version": F.lit(A.CURRENT)})
    dim = again.select(F.size("vector")).first()[0]
    return store.upsert_vectors(now, again, A.CURRENT, dim).select("id", "model_version", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@query(f"WITH {PAGES}, {CLICKS}, o AS (SELECT record_id, max(ts) AS opened FROM clicks GROUP BY 1) SELECT folder_path, count(*) AS size, max(greatest(date_added, coalesce(opened, 0))) AS active FROM records r LEFT JOIN o ON o.record_id = r.id GROUP BY folder_path")
def folder_activity(spark: SparkSession, d: str) -> DataFrame:
    b = search.browse(A.records(spark, d), A.clicks(spark, d))
    return b.groupBy("folder_path").agg(F.count("*").alias("size"), F.max("activity").alias("active"))


_REBUILT = (
    "rebuilt AS (SELECT * REPLACE (CASE WHEN old THEN status ELSE 'pending' END AS status, CASE WHEN old THEN og_title END AS og_title, CASE WHEN old THEN meta_description END AS meta_description, CASE WHEN old THEN site_name END AS site_name, "
    "CASE WHEN old THEN headings ELSE [] END AS headings, CASE WHEN old THEN excerpt END AS excerpt, CASE WHEN old THEN tags ELSE [] END AS tags) FROM (SELECT *, page_id % 10 <> 0 AS old FROM records))"
)


@query(f"WITH {PAGES}, {_REBUILT}, {composite_sql('rebuilt')} SELECT id, title, status, array_to_string(tags, ',') AS tags, composite_text FROM rebuilt JOIN composed USING (id)")
def rebuilt_records(spark: SparkSession, d: str) -> DataFrame:
    return library.rebuild(A.records(spark, d), A.existing_records(spark, d)).select("id", "title", "status", F.array_join("tags", ",").alias("tags"), "composite_text")


_FETCHED = (
    "o AS (SELECT *, CAST(user_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 2 = 0 THEN 'Fetched ' || event_id % 5 END AS title, CASE WHEN event_id % 3 = 0 THEN 'Fetched notes ' || event_id % 7 END AS said FROM events), "
    "last AS (SELECT id, last(CASE WHEN event_type IN ('error', 'signup') THEN 'dead' ELSE 'full' END ORDER BY ms, event_id) AS s, last(title ORDER BY ms, event_id) FILTER (title IS NOT NULL) AS t, last(said ORDER BY ms, event_id) FILTER (said IS NOT NULL) AS d FROM o GROUP BY id), "
    "outcome AS (SELECT r.* REPLACE (coalesce(s, status) AS status, coalesce(t, og_title) AS og_title, coalesce(d, meta_description) AS meta_description) FROM records r LEFT JOIN last USING (id))"
)


@query(f"WITH {PAGES}, {_FETCHED}, {composite_sql('outcome')}, now AS (SELECT * FROM composed), before AS (WITH {composite_sql('records')} SELECT * FROM composed) SELECT id, status, now.composite_text, now.composite_text <> before.composite_text AS stale FROM outcome JOIN now USING (id) JOIN before USING (id)")
def merged_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes with a title and a description now and then; records whose text they change lose their model version."""
    n = F.col("event_id")
    said = {"title": F.when(n % 2 == 0, F.concat(F.lit("Fetched "), n % 5)), "meta_description": F.when(n % 3 == 0, F.concat(F.lit("Fetched notes "), n % 7))}
    records = library.with_composite(A.records(spark, d)).withColumn("model_version", F.lit(A.CURRENT))
    made = crawl.merge_outcome(records, A.outcomes(spark, d).withColumns(said))
    return made.select("id", "status", "composite_text", F.col("model_version").isNull().alias("stale"))


@query(f"WITH {PAGES} SELECT id, title FROM records QUALIFY row_number() OVER (PARTITION BY host ORDER BY date_added DESC) = 1")
def latest_by_host(spark: SparkSession, d: str) -> DataFrame:
    rows = A.records(spark, d).select("id", "title", url.domain(F.col("canonical_url")).alias("host"), "date_added")
    return store.latest(rows, "host", "date_added").select("id", "title")


@query(f"WITH {PAGES} SELECT folder_path, count(*) AS n, string_agg(title, '|' ORDER BY page_id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY folder_path ORDER BY page_id) AS k FROM records) WHERE k <= 4 GROUP BY folder_path")
def topic_samples(spark: SparkSession, d: str) -> DataFrame:
    """At most four sample titles of each group, cut before they are gathered."""
    n = F.col("id").cast("long")
    order = Window.partitionBy("folder_path").orderBy(n)
    few = A.records(spark, d).withColumn("k", F.row_number().over(order)).where("k <= 4")
    listed = few.groupBy("folder_path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("k", "title"))).alias("s"))
    return listed.select("folder_path", "n", F.array_join(F.transform("s", lambda x: x["title"]), "|").alias("samples"))
