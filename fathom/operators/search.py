"""Ranked search: lexical coverage, vector similarity, their fusion, click feedback, browsing and suggestions.

Every operator takes a batch of queries and keeps its windows within a query. A query's candidates are the records
with a token that one of its own starts, found by a lookup in the batch, and those above the similarity floor.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions.records import SIGNALS, all_tags, optional
from fathom.functions.vectors import dot, normalize


@dataclass(frozen=True)
class Weights:
    """Ranking parameters. The defaults."""

    lexical: float = 0.55
    semantic: float = 0.45
    floor: float = 0.5
    sharpness: float = 5.0
    blend: float = 0.6
    min_score: float = 0.05
    limit: int = 150

    #: What an override has to lie within.
    BOUNDS = {"lexical": (0, 1), "semantic": (0, 1), "floor": (0, 1), "sharpness": (0.1, 100), "blend": (0, 1), "min_score": (0, 1), "limit": (1, 10_000)}

    @classmethod
    def of(cls, override: dict | None) -> Weights:
        """Defaults with the finite numbers of override that are within bounds."""
        kept = {}
        for f in fields(cls):
            x = (override or {}).get(f.name)
            low, high = cls.BOUNDS[f.name]
            if isinstance(x, (int, float)) and not isinstance(x, bool) and low <= x <= high:
                kept[f.name] = x
        return cls(**kept)


#: What each field is worth; a prefix hit counts 0.8; each further field adds 0.05.
FIELDS = (("title", "title", 0.90), ("tag", "tags", 0.65), ("url", "canonical_url", 0.55), ("folder", "folder_path", 0.40), ("description", "description", 0.35))
PREFIX, BONUS, REASON_AT = 0.8, 0.05, 0.45


def token_hit(tokens: Column, wanted: Column) -> Column:
    return F.when(F.array_contains(tokens, wanted), F.lit(1.0)).when(F.exists(tokens, lambda t: F.startswith(t, wanted)), F.lit(PREFIX)).otherwise(F.lit(0.0))


def coverage(tokens: Column, wanted: Column) -> Column:
    """Mean token hit over the query's tokens; 0 for none."""
    total = F.aggregate(wanted, F.lit(0.0), lambda s, w: s + token_hit(tokens, w))
    return F.when(F.size(wanted) > 0, total / F.size(wanted)).otherwise(F.lit(0.0))


def with_tokens(records: DataFrame) -> DataFrame:
    """records with the tokens of every field that search looks at."""
    joined = F.array_join(all_tags(records), " ")
    described = F.concat_ws(" ", *[optional(records, c, SIGNALS[c]) for c in ("meta_description", "site_name", "headings")])
    return records.withColumns({
        "title_tokens": T.tokenize(F.col("title")),
        "tag_tokens": T.tokenize(joined),
        "url_tokens": T.tokenize(F.when(F.col("canonical_url") != "", F.col("canonical_url")).otherwise(F.col("url"))),
        "folder_tokens": T.tokenize(F.col("folder_path")),
        "description_tokens": T.tokenize(described),
    })


def prepared(queries: DataFrame) -> DataFrame:
    """queries with tokens and phrase, without those that have no token."""
    q = queries.withColumn("q_tokens", T.tokenize(F.col("text"))).withColumn("phrase", F.lower(T.trim(F.col("text"))))
    return q.where(F.size("q_tokens") > 0)


def with_candidates(records: DataFrame, queries: DataFrame) -> DataFrame:
    """records once for each query of the batch that has a token which starts one of theirs, with q_tokens and phrase.

    The batch's tokens, filed by their first two characters (tokens have two at least), come to the records as
    one row; records are looked up where they are, without a shuffle, and meet no other query.
    """
    wanted = queries.select("query_id", F.explode("q_tokens").alias("wanted"))
    filed = wanted.groupBy(F.left("wanted", F.lit(2)).alias("start")).agg(F.collect_list(F.struct("query_id", "wanted")).alias("q"))
    table = filed.agg(F.map_from_entries(F.collect_list(F.struct("start", "q"))).alias("filed"))
    tokens = F.array_distinct(F.flatten(F.array("title_tokens", "tag_tokens", "url_tokens", "folder_tokens", "description_tokens")))

    def asking(token):
        found = F.filter(F.try_element_at("filed", F.left(token, F.lit(2))), lambda x: F.startswith(token, x["wanted"]))
        return F.coalesce(F.transform(found, lambda x: x["query_id"]), F.array().cast("array<bigint>"))

    met = records.join(F.broadcast(table)).withColumn("query_id", F.explode(F.array_distinct(F.flatten(F.transform(tokens, asking))))).drop("filed")  # one row
    return met.join(F.broadcast(queries.select("query_id", "q_tokens", "phrase")), "query_id")  # the stated queries of one batch


def lexical(records: DataFrame, queries: DataFrame, *keep: str) -> DataFrame:
    """(query_id, id, lex, lex_reason) and the kept columns of records with a positive lexical score."""
    pairs = with_candidates(with_tokens(records), prepared(queries))
    phrase = F.when((F.size("q_tokens") >= 2) & (F.length("phrase") >= 2) & F.contains(F.lower("title"), F.col("phrase")), 1.0).otherwise(0.0)
    parts = [("title", phrase), *((reason, coverage(F.col(f"{reason}_tokens"), F.col("q_tokens")) * worth) for reason, _, worth in FIELDS)]
    scored = pairs.select("query_id", "id", *keep, F.array(*[F.struct(x.alias("s"), F.lit(r).alias("r")) for r, x in parts]).alias("c"))
    best = F.aggregate("c", F.struct(F.lit(0.0).alias("s"), F.lit("title").alias("r")), lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))
    more = F.size(F.filter("c", lambda x: x["s"] > 0)) - 1
    score = F.least(F.lit(1.0), best["s"] + BONUS * more)
    return scored.select("query_id", "id", *keep, F.when(best["s"] > 0, score).otherwise(0.0).alias("lex"), best["r"].alias("lex_reason")).where("lex > 0")


def cosines(vectors: DataFrame, queries: DataFrame, above: float | None = None) -> DataFrame:
    """(query_id, id, cos): every vector scored for every query of the batch; rows at or below `above` are left out.

    The batch of queries is broadcast: it is the caller's, some hundred vectors at most. A vector of another length
    than the query raises with its id. Ids are strings; ties are ordered as strings everywhere.
    """
    asked = queries.select("query_id", normalize(F.col("vector")).alias("q"))
    other = F.raise_error(F.concat(F.lit("vector "), F.col("id"), F.lit(" has another length than the query"))).cast("boolean")
    met = vectors.join(F.broadcast(asked)).where(F.when(F.size("q") == F.size("vector"), True).otherwise(other))
    scored = met.select("query_id", "id", F.round(dot(F.col("vector"), F.col("q")), 6).alias("cos"))
    return scored if above is None else scored.where(F.col("cos") > above)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query: (query_id, id, cos, rank); ties to the smaller id. k <= 0 gives none."""
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "id")
    return cosines(vectors, queries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0))


def semantic(vectors: DataFrame, queries: DataFrame, w: Weights) -> DataFrame:
    """(query_id, id, cos, rank, sem): rows above the floor; those below have none and rank after all of these."""
    within = Window.partitionBy("query_id")
    order = within.orderBy(F.desc("cos"), "id")
    ranked = cosines(vectors, queries, w.floor).withColumns({"rank": F.row_number().over(order), "top": F.max("cos").over(within)})
    quality = (w.sharpness + 1) / (w.sharpness + F.col("rank"))
    span = F.col("top") - w.floor
    magnitude = F.when(span <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("cos") - w.floor) / F.nullif(span, F.lit(0.0)))))
    return ranked.select("query_id", "id", "cos", "rank", (w.blend * quality + (1 - w.blend) * magnitude).alias("sem"))


def hybrid(records: DataFrame, vectors: DataFrame | None, queries: DataFrame, w: Weights = Weights()) -> DataFrame:
    """(query_id, rank, id, score, reason): the fused ranking, at most w.limit rows a query. Without vectors, lexical only."""
    lex = lexical(records, queries, "title")
    if vectors is None:
        both = lex.withColumn("sem", F.lit(0.0))
    else:
        named = records.select("id", F.col("title").alias("named"))
        sem = semantic(vectors, prepared(queries), w).select("query_id", "id", "sem").join(named, "id")
        both = lex.join(sem, ["query_id", "id"], "full").withColumn("title", F.coalesce("title", "named")).na.fill({"lex": 0.0, "sem": 0.0, "lex_reason": "title"})
    score = F.round(w.lexical * F.col("lex") + w.semantic * F.col("sem"), 6)
    reason = F.when((F.col("lex") >= REASON_AT) & (w.lexical * F.col("lex") >= w.semantic * F.col("sem")), F.col("lex_reason")).otherwise("semantic")
    scored = both.select("query_id", "id", "title", score.alias("score"), reason.alias("reason")).where(F.col("score") >= w.min_score)
    return ranked(scored, w.limit).select("query_id", "rank", "id", "score", "reason")


def versions(records: DataFrame, vectors: DataFrame, queries: DataFrame, w: Weights = Weights()) -> DataFrame:
    """(query_id, version, pending, rank, id, score, reason): a lexical answer of every query at once, version 0, and the fused one, version 1.

    pending says that a later version is to come: queries (query_id, text, vector) with a null vector have none yet. A query
    without hits has one row of null rank, so that an empty answer replaces a full one too.
    """
    has = F.col("vector").isNotNull()
    first = hybrid(records, None, queries, w).withColumn("version", F.lit(0))
    second = hybrid(records, vectors, queries.where(has), w).withColumn("version", F.lit(1))
    answered = queries.select("query_id", F.explode(F.when(has, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("version"))
    hits = answered.join(first.unionByName(second), ["query_id", "version"], "left")
    return hits.select("query_id", "version", (F.col("version") == 0).alias("pending"), "rank", "id", "score", "reason")


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.lower("title"), "title", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


# --- feedback

HALF_LIFE_MS, GATE, NEUTRAL, SLOPE, MOST_WEIGHT, CAP, STRENGTH = 30 * 86_400_000, 0.5, 3, 0.05, 1.5, 1.1, 0.25


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def position_weight(rank: Column) -> Column:
    return F.when(rank <= NEUTRAL, 1.0).otherwise(F.least(F.lit(MOST_WEIGHT), 1 + SLOPE * (rank - NEUTRAL)))


def recency(age_ms: Column) -> Column:
    return F.when(age_ms <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_ms / HALF_LIFE_MS))


def click_signals(clicks: DataFrame, queries: DataFrame, now_ms: int) -> DataFrame:
    """(query_id, id, signal): decayed, position-weighted clicks of like queries.

    Clicks are summed by query text first, so a text clicked a billion times meets a query once a record.
    """
    weight = position_weight(F.col("rank")) * recency(F.lit(now_ms) - F.col("ts"))
    sums = clicks.where("sat and record_id <> '' and rank >= 1").groupBy("query_norm", "record_id").agg(F.sum(weight).alias("w"))
    asked = prepared(queries).select("query_id", "q_tokens", F.array_join(F.array_sort("q_tokens"), " ").alias("norm"))
    tokens = F.split("query_norm", " ")
    like = F.when(F.col("norm") == F.col("query_norm"), 1.0).otherwise(jaccard(F.col("q_tokens"), tokens))
    texts = sums.select("query_norm").distinct().select("query_norm", F.explode(tokens).alias("token"))
    pairs = texts.join(asked.select("*", F.explode("q_tokens").alias("token")), "token").select("query_id", "q_tokens", "norm", "query_norm").distinct().withColumn("like", like).where(F.col("like") >= GATE)
    scored = pairs.join(sums, "query_norm").groupBy("query_id", F.col("record_id").alias("id")).agg(F.sum(F.col("like") * F.col("w")).alias("s"))
    return scored.select("query_id", "id", F.round(F.least(F.lit(CAP), F.log1p("s")), 6).alias("signal"))


def boosted(hits: DataFrame, signals: DataFrame, records: DataFrame) -> DataFrame:
    """hits re-ranked by signal: the same rows, each score at most 1.275 times what it was."""
    joined = hits.drop("rank").join(signals, ["query_id", "id"], "left").join(records.select("id", "title"), "id")
    score = F.round(F.col("score") * (1 + STRENGTH * F.coalesce("signal", F.lit(0.0))), 6)
    return ranked(joined.withColumn("score", score), 1 << 30).select("query_id", "rank", "id", "score", "reason")


# --- browse and suggest


def in_folder(path: Column, folder: str) -> Column:
    return (path == folder) | F.startswith(path, F.lit(folder + " / "))


def last_opened(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(F.col("record_id").alias("id")).agg(F.max("ts").alias("opened"))


def browse(records: DataFrame, clicks: DataFrame, sort: str = "recent", folder: str | None = None) -> DataFrame:
    """(id, title, folder_path, activity) of a subtree, by activity or by name."""
    rows = records if folder is None else records.where(in_folder(F.col("folder_path"), folder))
    active = F.greatest("date_added", F.coalesce("opened", F.lit(0)))
    found = rows.join(last_opened(clicks), "id", "left").select("id", "title", "folder_path", "date_added", active.alias("activity"))
    name = [F.lower("title"), F.col("title")]
    order = [F.desc("activity"), *name] if sort == "recent" else [*name, F.desc("date_added")]
    return found.orderBy(*order, "id").select("id", "title", "folder_path", "activity")


def folder_paths(records: DataFrame) -> DataFrame:
    return records.where("folder_path <> ''").select("folder_path").distinct()


def suggestions(hits: DataFrame, records: DataFrame, queries: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, place, id, content): the first rows of each query, one a URL, with matches marked."""
    rows = hits.join(records.select("id", "title", "url"), "id").join(F.broadcast(queries.select("query_id", T.tokenize(F.col("text")).alias("q_tokens"))), "query_id")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("rank"))).where("n = 1")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= most)
    shown = T.mark_matches(F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url")), F.col("q_tokens"))
    return placed.select("query_id", "place", "id", F.concat(shown, F.lit(" <dim>- </dim><url>"), T.escape_xml(F.col("url")), F.lit("</url>")).alias("content"))


def suggested_urls(hits: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, url, id, rank): the record that stands for a URL among a query's hits, the first by rank; what was opened is found by it."""
    rows = hits.join(records.select("id", "url"), "id")
    return rows.groupBy("query_id", "url").agg(F.min(F.struct("rank", "id")).alias("first")).select("query_id", "url", "first.id", "first.rank")


def hit_row(records: DataFrame) -> DataFrame:
    """What a hit shows besides its score: description or else excerpt, at most 240 characters, all tags, and whether the page is gone."""
    described = F.left(F.coalesce(optional(records, "meta_description"), optional(records, "excerpt")), F.lit(240))
    return records.select("id", "title", "url", "folder_path", "date_added", F.nullif(described, F.lit("")).alias("description"), all_tags(records).alias("tags"), (F.col("status") == "dead").alias("dead"))


def evaluate(ranked_: DataFrame, expected: DataFrame, records: DataFrame, queries: DataFrame) -> DataFrame:
    """(queries, hit_rate, mrr): expected (query_id, expect array, k); a hit's URL contains one of them."""
    hits = ranked_.join(records.select("id", "url"), "id").join(expected, "query_id")
    good = hits.where(F.exists("expect", lambda e: F.contains(F.lower("url"), F.lower(e)))).groupBy("query_id").agg(F.min("rank").alias("first"))
    every = queries.select("query_id").join(expected, "query_id").join(good, "query_id", "left")
    return every.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
