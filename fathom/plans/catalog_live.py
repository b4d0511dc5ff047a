"""Registered queries of what keeps a library current: trees under change, retries, answers that are refined, learned topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import hierarchy, search
from fathom.plans.catalog import ASKED, FUSED, LEXICAL, PAGES, SEMANTIC, WEIGHTS, _tree, query
from fathom.sources import adapters as A
from fathom.streaming import changes

# --- a tree under change


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the customers' tree from events: leaves and folders created, changed, moved, removed and created again."""
    e, kind = F.col("event_id"), F.col("event_type")
    leaf, nation, region = (F.concat(F.lit(p), x.cast("string")) for p, x in (("c", F.col("user_id")), ("n", e % 25), ("r", e % 5)))
    none = F.lit(None).cast("string")
    cases = [
        (kind == "click", "changed", leaf, none, F.concat(F.lit("renamed "), e), F.when(e % 2 == 0, F.concat(F.lit("https://y.example/"), e))),
        (kind == "view", "moved", leaf, F.when(e % 7 == 0, F.concat(F.lit("f"), e - e % 50)).otherwise(nation), none, none),
        (kind == "error", "removed", leaf, none, none, none),
        ((kind == "signup") & (e % 11 == 0), "created", F.concat(F.lit("f"), e - e % 50), nation, F.concat(F.lit("folder "), e), none),
        (kind == "signup", "created", F.concat(F.lit("x"), e), F.when(e % 3 == 0, F.concat(F.lit("f"), e - e % 50)).otherwise(nation), F.concat(F.lit("leaf "), e), F.lit("https://z.example/")),
        (e % 13 == 0, "moved", nation, region, none, none),
        (e % 17 == 0, "changed", nation, none, F.concat(F.lit("nation "), e), none),
        (e % 97 == 0, "removed", nation, none, none, none),
        (e % 5 == 0, "created", nation, region, F.concat(F.lit("again "), e), none),
        (e % 101 == 0, "moved", F.concat(F.lit("f"), e - e % 50), F.concat(F.lit("f"), e % 300 - e % 50), none, none),
    ]
    chosen = F.lit(None)
    for when, op, node, parent, title, url in reversed(cases):
        chosen = F.when(when, F.struct(node.alias("id"), F.lit(op).alias("op"), parent.alias("parent_id"), title.alias("title"), url.alias("url"))).otherwise(chosen)
    return A.table(spark, d, "events").select(e.alias("seq"), chosen.alias("c")).where("c is not null").select("seq", "c.*")


#: The whole tree anew from the changes' last values, from the roots down.
_TREE = """
nodes AS (
    SELECT 'root' AS id, CAST(NULL AS VARCHAR) AS parent_id, '' AS title, CAST(NULL AS VARCHAR) AS url UNION ALL SELECT 'r' || r_regionkey, 'root', r_name, NULL FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, NULL FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 'https://x.example/' FROM customer
),
told AS (
    SELECT event_id AS seq, CASE
        WHEN event_type = 'click' THEN {'id': 'c' || user_id, 'op': 'changed', 'p': NULL, 't': 'renamed ' || event_id, 'u': CASE WHEN event_id % 2 = 0 THEN 'https://y.example/' || event_id END}
        WHEN event_type = 'view' THEN {'id': 'c' || user_id, 'op': 'moved', 'p': CASE WHEN event_id % 7 = 0 THEN 'f' || (event_id - event_id % 50) ELSE 'n' || (event_id % 25) END, 't': NULL, 'u': NULL}
        WHEN event_type = 'error' THEN {'id': 'c' || user_id, 'op': 'removed', 'p': NULL, 't': NULL, 'u': NULL}
        WHEN event_type = 'signup' AND event_id % 11 = 0 THEN {'id': 'f' || (event_id - event_id % 50), 'op': 'created', 'p': 'n' || (event_id % 25), 't': 'folder ' || event_id, 'u': NULL}
        WHEN event_type = 'signup' THEN {'id': 'x' || event_id, 'op': 'created', 'p': CASE WHEN event_id % 3 = 0 THEN 'f' || (event_id - event_id % 50) ELSE 'n' || (event_id % 25) END, 't': 'leaf ' || event_id, 'u': 'https://z.example/'}
        WHEN event_id % 13 = 0 THEN {'id': 'n' || (event_id % 25), 'op': 'moved', 'p': 'r' || (event_id % 5), 't': NULL, 'u': NULL}
        WHEN event_id % 17 = 0 THEN {'id': 'n' || (event_id % 25), 'op': 'changed', 'p': NULL, 't': 'nation ' || event_id, 'u': NULL}
        WHEN event_id % 97 = 0 THEN {'id': 'n' || (event_id % 25), 'op': 'removed', 'p': NULL, 't': NULL, 'u': NULL}
        WHEN event_id % 5 = 0 THEN {'id': 'n' || (event_id % 25), 'op': 'created', 'p': 'r' || (event_id % 5), 't': 'again ' || event_id, 'u': NULL}
        WHEN event_id % 101 = 0 THEN {'id': 'f' || (event_id - event_id % 50), 'op': 'moved', 'p': 'f' || (event_id % 300 - event_id % 50), 't': NULL, 'u': NULL}
    END AS c FROM events
),
last AS (
    SELECT c.id AS id, max(seq) FILTER (c.op = 'created') AS born, max(seq) FILTER (c.op = 'removed') AS gone, max(seq) FILTER (c.op IN ('created', 'moved')) AS link,
           arg_max({'v': CAST(c.p AS VARCHAR)}, seq) FILTER (c.op IN ('created', 'moved')) AS p, arg_max({'v': CAST(c.t AS VARCHAR)}, seq) FILTER (c.op IN ('created', 'changed')) AS t,
           arg_max({'v': CAST(c.u AS VARCHAR)}, seq) FILTER (c.op = 'created' OR c.op = 'changed' AND c.u IS NOT NULL) AS u
    FROM told WHERE c IS NOT NULL GROUP BY 1
),
final AS (
    SELECT coalesce(n.id, l.id) AS id, CASE WHEN p IS NULL THEN parent_id ELSE p.v END AS parent_id, CASE WHEN t IS NULL THEN title ELSE t.v END AS title, CASE WHEN u IS NULL THEN url ELSE u.v END AS url, link, gone
    FROM nodes n FULL JOIN last l ON n.id = l.id WHERE (n.id IS NOT NULL OR born IS NOT NULL) AND (gone IS NULL OR born > gone)
),
walk AS (
    SELECT id, parent_id, url, gone, '' AS path, 0 AS depth FROM final WHERE parent_id IS NULL
    UNION ALL
    SELECT f.id, f.parent_id, f.url, f.gone, CASE WHEN f.url IS NOT NULL OR coalesce(f.title, '') = '' THEN w.path WHEN w.path = '' THEN f.title ELSE w.path || ' / ' || f.title END, depth + 1
    FROM walk w JOIN final f ON f.parent_id = w.id AND w.url IS NULL AND (w.gone IS NULL OR f.link >= w.gone)
)"""


@query(f"WITH RECURSIVE {_TREE} SELECT id, parent_id, url, path, CAST(depth AS INTEGER) AS depth FROM walk")
def tree_after_changes(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.index(_tree(spark, d))
    after = hierarchy.merged(tree, hierarchy.apply_changes(tree, _changes(spark, d)))
    return after.select("id", "parent_id", "url", "path", F.size("ancestors").alias("depth"))


@query(
    f"""WITH RECURSIVE {_TREE}, before AS (SELECT 'c' || c_custkey AS id, r_name || ' / ' || n_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
after AS (SELECT id, path FROM walk WHERE url IS NOT NULL)
SELECT CASE WHEN b.id IS NULL THEN 'created' WHEN a.id IS NULL THEN 'removed' ELSE 'moved' END AS action, count(*) AS n FROM before b FULL JOIN after a ON a.id = b.id WHERE a.path IS DISTINCT FROM b.path GROUP BY 1"""
)
def tree_moves(spark: SparkSession, d: str) -> DataFrame:
    """How many leaves came, went, or have another path."""
    tree = hierarchy.index(_tree(spark, d))
    leaves = hierarchy.apply_changes(tree, _changes(spark, d)).where("url is not null and action <> 'unchanged'")
    was = tree.select("id", F.col("path").alias("before"))
    found = leaves.join(was, "id", "left").where("action <> 'updated' or path <> before")
    return found.groupBy(F.when(F.col("action") == "updated", "moved").otherwise(F.col("action")).alias("action")).agg(F.count("*").alias("n"))


# --- retries

_RETRIES = """
told AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id, event_type = 'error' AS again, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
steps AS (
    SELECT id, event_id, ms, nth, CASE WHEN again THEN 1 ELSE 0 END AS tried FROM told WHERE nth = 1
    UNION ALL
    SELECT t.id, t.event_id, t.ms, t.nth, CASE WHEN t.again AND s.tried + 1 < 3 THEN s.tried + 1 ELSE 0 END FROM steps s JOIN told t ON t.id = s.id AND t.nth = s.nth + 1
),
due AS (SELECT s.id, s.event_id, s.tried, s.ms + 30000 * CAST(pow(4, s.tried - 1) AS BIGINT) AS due_ms, n.ms AS next FROM steps s LEFT JOIN told n ON n.id = s.id AND n.nth = s.nth + 1 WHERE s.tried > 0)"""


@query(f"WITH RECURSIVE {_RETRIES} SELECT id, event_id, CAST(tried AS INTEGER) AS attempts, due_ms FROM due WHERE next IS NULL OR next >= due_ms")
def retry_timers(spark: SparkSession, d: str) -> DataFrame:
    return changes.retries(A.outcomes(spark, d).withColumn("ts", F.timestamp_micros(F.col("us"))))


# --- answers that are refined

_VERSIONS = f"""
WITH {PAGES}, {ASKED}, {LEXICAL}, {SEMANTIC}, {FUSED},
lexical_only AS (SELECT l.query_id, l.id, round(0.55::DOUBLE * lex, 6) AS score, CASE WHEN lex >= 0.45 THEN lex_reason ELSE 'semantic' END AS reason, title FROM lex l JOIN records r ON r.id = l.id),
first AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(title), title, id) AS INTEGER) AS rank, id, score, reason FROM lexical_only WHERE score >= 0.05 QUALIFY rank <= 150),
ready AS (SELECT query_id, vec_id % 11 <> 0 AS refined FROM asked)"""


@query(
    f"{_VERSIONS} SELECT CAST(q.query_id AS BIGINT) AS query_id, 1 AS version, false AS pending, rank, id, score, reason FROM ready q LEFT JOIN hits h ON h.query_id = q.query_id WHERE refined "
    "UNION ALL SELECT CAST(q.query_id AS BIGINT), 0, true, rank, id, score, reason FROM ready q LEFT JOIN first f ON f.query_id = q.query_id WHERE NOT refined"
)
def refined_hits(spark: SparkSession, d: str) -> DataFrame:
    """Of each query the newest answer: fused where its vector is of the current model, lexical and pending where it is not yet."""
    asked = A.queries(spark, d).join(A.vectors(spark, d).where(F.col("model_version") == A.CURRENT).select("vec_id", "vector"), "vec_id", "left").select("query_id", "text", "vector")
    return changes.refined(search.versions(A.records(spark, d), A.vectors(spark, d), asked, WEIGHTS))


_HITS = f"WITH {PAGES}, {ASKED}, {LEXICAL}, {SEMANTIC}, {FUSED}"


@query(f"{_HITS} SELECT CAST(query_id AS BIGINT) AS query_id, url, h.id AS id, CAST(rank AS INTEGER) AS rank FROM hits h JOIN records r ON r.id = h.id QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY rank) = 1")
def suggested_urls(spark: SparkSession, d: str) -> DataFrame:
    records = A.records(spark, d)
    return search.suggested_urls(search.hybrid(records, A.vectors(spark, d), A.query_vectors(spark, d), WEIGHTS), records)
