"""The engine's canonical tables, derived from the star-schema and page tables that stand in for a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import html, text, url

DAY_MS, START_MS, CURRENT = 86_400_000, 1_700_000_000_000, "fixture@1"
#: ASCII letters alone: upper() of other ones differs between engines.
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a page: id, url, canonical_url, title, folder_path, date_added, signals, tags, learned_tags and status.

    The pages hold no meta tags, so og_title, meta_description, site_name, excerpt and learned_tags stand in for them, by page_id.
    """
    pages = table(spark, sf_dir, "pages")
    canonical, n = url.canonical(F.col("url")), F.col("page_id")
    title, section = F.coalesce(html.title(F.col("html")), F.lit("")), F.regexp_extract("url", "^https?://[^/]+/([^/?#]+)", 1)
    return pages.select(
        F.col("page_id").cast("string").alias("id"),
        "url",
        canonical.alias("canonical_url"),
        title.alias("title"),
        F.concat(F.lit("Library / "), section, F.lit(" / "), url.domain(canonical)).alias("folder_path"),
        (F.lit(START_MS) + F.col("page_id") * DAY_MS).alias("date_added"),
        F.when(n % 4 == 0, F.translate(title, LOWER, UPPER)).when(n % 4 == 1, F.concat(F.lit("On "), title)).alias("og_title"),
        F.when(n % 3 != 2, F.concat(F.lit("Notes and links on the "), section, F.lit(" pages"))).alias("meta_description"),
        F.when(n % 5 < 2, F.concat(F.lit("The "), url.domain(canonical))).alias("site_name"),
        html.headings(F.col("html")).alias("headings"),
        F.when(n % 2 == 0, F.concat(F.lit("Going to the town with "), title)).alias("excerpt"),
        F.array(F.concat(F.lit("tag "), section)).alias("tags"),
        F.when(n % 6 == 0, F.array(F.concat(F.lit("topic of the "), section))).alias("learned_tags"),
        F.when(F.col("page_id") % 13 == 0, "dead").when(F.col("page_id") % 5 == 0, "pending").otherwise("full").alias("status"),
    )


def dressed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html): the pages with the meta tags, icon links and second headings that they lack, by page_id."""
    n = F.col("page_id")
    say = lambda when, *parts: F.when(when, F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])).otherwise("")
    head = F.concat(
        F.lit("<head>"),
        say(n % 3 == 0, '<META content="Notes &amp; links ', n, '" property="og:title">'),
        say(n % 4 == 1, "<meta property='og:description' content='On &lt;", n, "&gt;'>"),
        say((n % 4 == 1) | (n % 4 == 2), '<meta name="description" content=" plain ', n, ' ">'),
        say(n % 5 == 0, '<meta property="og:site_name" content="Site ', n % 7, '">'),
        say(n % 2 == 0, '<link rel="shortcut icon" href="/i16.png" sizes="16x16"><link rel="apple-touch-icon" href="/touch.png">'),
        say(n % 6 == 0, '<link rel="icon" type="image/svg+xml" href="https://cdn.example/s', n % 11, '">'),
        say(n % 7 == 3, '<link rel="stylesheet" href="/a.css">'),
    )
    article = F.concat(F.lit("<article>"), say(n % 3 == 1, "<h2>Part <i>", n, "</i></h2><h2> PART ", n, "</h2>"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace(F.replace("html", F.lit("<head>"), head), F.lit("<article>"), article).alias("html"))


def existing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older state of records: a tenth is missing, a seventh has another title, and ten rows have gone since."""
    now = records(spark, sf_dir)
    n = F.col("id").cast("long")
    kept = now.where(n % 10 != 0).withColumn("title", F.when(n % 7 == 0, F.concat("title", F.lit(" old"))).otherwise(F.col("title")))
    gone = now.where(n < 10).withColumn("id", (n + 1_000_000).cast("string"))
    return kept.unionByName(gone)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector a row with its model version; an eleventh is of an older model."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label", F.when(F.col("vec_id") % 11 == 0, "fixture@0").otherwise(CURRENT).alias("model_version"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, vec_id): fixed query texts, each with a stored vector as its embedding."""
    rows = [(0, "the and", 0), (1, "of the", 1), (2, "to", 2), (3, "ing tion", 3)]
    return spark.createDataFrame(rows, "query_id long, text string, vec_id long")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).join(vectors(spark, sf_dir).select("vec_id", "vector"), "vec_id").select("query_id", "text", "vector")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(click_id, query, query_norm, query_tokens, record_id, ts, rank, sat) from events."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase", "error"))
    k = F.get_json_object("props", "$.k").cast("long") % 4
    q = F.element_at(F.array(F.lit("the and"), F.lit("of the"), F.lit("to"), F.lit("the ing")), (k + 1).cast("int"))
    tokens = text.tokenize(q)
    return e.select(
        F.col("event_id").alias("click_id"),
        q.alias("query"),
        F.array_join(F.array_sort(tokens), " ").alias("query_norm"),
        tokens.alias("query_tokens"),
        F.col("user_id").cast("string").alias("record_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        (1 + F.col("event_id") % 20).alias("rank"),
        (F.col("event_type") != "error").alias("sat"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, id, attempts, status, detail, ts, us): crawl outcomes from events, their moments in milli- and microseconds."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("id"),
        (F.col("event_id") % 4).cast("int").alias("attempts"),
        F.when(kind.isin("error", "signup"), "dead").otherwise("full").alias("status"),
        F.when(kind == "error", "HTTP 503").when(kind == "signup", "HTTP 404").alias("detail"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )
