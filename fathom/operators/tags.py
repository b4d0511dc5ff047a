"""Tags: known hosts, nearest tag descriptions, and topics learned by clustering."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text, url
from fathom.functions.records import optional
from fathom.functions.tables import DOMAIN_TAGS, STOPWORDS, TAXONOMY
from fathom.functions.vectors import dot, normalize
from fathom.operators import clusters

#: Zero-shot threshold and count, tags a record; admission and assignment of topics.
THRESHOLD, BEST, MOST_TAGS = 0.45, 2, 4
MIN_CORPUS, MIN_SIZE, COHESION, ASSIGN, SEED, ROUNDS = 40, 6, 0.65, 0.62, 1337, 30


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TAXONOMY)], "ordinal int, id string, label string, description string")


def host_tags(records: DataFrame, table: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """records with `heuristic`: tags of the host, else of its last two labels, and what some paths add or replace."""
    table = DOMAIN_TAGS if table is None else table
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(t) for t in x]) for item in table.items() for x in item])  # a fixed table
    host, path = url.domain(F.col("canonical_url")), F.coalesce(F.try_parse_url("canonical_url", F.lit("PATH")), F.lit(""))
    none = F.array().cast("array<string>")
    base = F.coalesce(F.try_element_at(known, host), F.try_element_at(known, url.registrable(host)), none)
    help_path = (host == "github.com") & path.rlike("/(issues|pull|discussions)(/|$)")
    google = F.when(F.startswith(path, F.lit("/maps")) | F.startswith(path, F.lit("/travel")), F.array(F.lit("travel"))).when(F.startswith(path, F.lit("/finance")), F.array(F.lit("finance")))
    refined = F.when(help_path, F.array_distinct(F.concat(base, F.array(F.lit("dev-help"))))).when(host == "google.com", F.coalesce(google, base)).otherwise(base)
    return records.withColumn("heuristic", refined)


def zero_shot(vectors: DataFrame, tags: DataFrame, threshold: float = THRESHOLD, best: int = BEST) -> DataFrame:
    """(id, tag, score, place): the best tags (tag, ordinal, vector) of each vector at or above the threshold.

    Tags are a fixed dimension, broadcast; the best are kept by an array sort within the row, without a shuffle.
    """
    all_tags = tags.agg(F.array_sort(F.collect_list(F.struct("ordinal", "tag", normalize(F.col("vector")).alias("v")))).alias("tags"))
    rows = vectors.select("id", normalize(F.col("vector")).alias("own")).join(F.broadcast(all_tags))  # one row
    fitting = F.filter("tags", lambda t: F.size(t["v"]) == F.size("own"))
    scored = F.transform(fitting, lambda t: F.struct((-F.round(dot(F.col("own"), t["v"]), 6)).alias("minus"), t["ordinal"].alias("ordinal"), t["tag"].alias("tag")))
    top = F.slice(F.array_sort(F.filter(scored, lambda s: -s["minus"] >= threshold)), 1, best)
    return rows.select("id", F.posexplode(top).alias("place", "s")).select("id", "s.tag", (-F.col("s.minus")).alias("score"), (F.col("place") + 1).alias("place"))


def merged(heuristic, learned):
    """Heuristic tags first, then zero-shot, distinct, at most four."""
    return F.slice(F.array_distinct(F.concat(heuristic, learned)), 1, MOST_TAGS)


# --- topics


def choose_k(n: int) -> int:
    return min(30, max(6, math.floor(math.sqrt(n / 2) + 0.5)))


def needs_rebuild(stored: dict | None, stamp: str, embedded: int, enriched: int) -> bool:
    """Whether topics drifted: a tenth, 25 rows at least, on either count."""
    if stored is None or stored["stamp"] != stamp:
        return True
    return any(abs(now - before) >= max(25, math.ceil(0.1 * before)) for now, before in ((embedded, stored["embedded"]), (enriched, stored["enriched"])))


def enriched(status):
    return status.isin("full", "meta_only")


def drift(records: DataFrame, vectors: DataFrame, version: str, stored: dict | None) -> DataFrame:
    """One row (embedded, enriched, rebuild): records with a vector of the version, those of them enriched, and whether topics are due."""
    own = records.join(vectors.where(F.col("model_version") == version).select("id"), "id", "left_semi")
    now = own.agg(F.count("*").alias("embedded"), F.count_if(enriched(F.col("status"))).alias("enriched"))
    if stored is None or stored["stamp"] != topics_stamp(version):
        return now.withColumn("rebuild", F.lit(True))
    far = [F.abs(F.col(n) - stored[n]) >= max(25, math.ceil(0.1 * stored[n])) for n in ("embedded", "enriched")]
    return now.withColumn("rebuild", far[0] | far[1])


def topics_stamp(model_version: str) -> str:
    return f"v3#{model_version}"


def label_worthy(token):
    """Three characters or more, no stop word, not all digits."""
    return (F.length(token) >= 3) & ~token.isin(*STOPWORDS) & ~token.rlike("^[0-9]+$")


def topic_tokens(document):
    """Distinct label-worthy tokens."""
    return F.filter(text.tokenize(document), label_worthy)


def topic_text(records: DataFrame):
    """What a record's page says it is: title, site name and description; no folders, no excerpt."""
    return F.concat_ws(" ", "title", optional(records, "site_name"), optional(records, "meta_description"))


def tag_text(records: DataFrame):
    """The text a record is classified from: title, description and site name, a line each; its composite text without these."""
    parts = F.filter(F.array(*[text.trim(F.coalesce(x, F.lit(""))) for x in (F.col("title"), optional(records, "meta_description"), optional(records, "site_name"))]), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise(optional(records, "composite_text"))


def topic_terms(docs: DataFrame) -> DataFrame:
    """(cluster, term, df_c, score) of docs (cluster, tokens): class-based TF-IDF of terms that enough documents share.

    Tokens are distinct ones of a document; what is not label-worthy is left out here, as a column and in the JVM's
    compiled code. One pass counts (cluster, term); a term's counts, one a cluster, give its count in the corpus.
    """
    sizes = docs.groupBy("cluster").agg(F.count("*").alias("n"))
    average = sizes.agg(F.avg("n").alias("avg_n"))
    in_cluster = docs.select("cluster", F.explode("tokens").alias("term")).where(label_worthy(F.col("term"))).groupBy("cluster", "term").agg(F.count("*").alias("df_c"))
    by_term = in_cluster.groupBy("term").agg(F.sum("df_c").alias("df"), F.collect_list(F.struct("cluster", "df_c")).alias("c"))
    joined = by_term.select("term", "df", F.inline("c")).join(sizes, "cluster").join(average)  # one row
    score = F.round(F.col("df_c") / F.greatest("n", F.lit(1)) * F.log1p(F.col("avg_n") / F.col("df")), 6)
    return joined.where("df_c >= greatest(2, ceil(0.15 * n))").select("cluster", "term", "df_c", score.alias("score"))


def label_clusters(terms: DataFrame, named: DataFrame) -> DataFrame:
    """(cluster, label): two terms by score, none a prefix-of-four of a chosen one, each pair once over all clusters.

    Sequential by definition, over at most 30 clusters and the terms that 15 % of a cluster's documents share.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "term")
    best = terms.withColumn("n", F.row_number().over(order)).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("n", "term"))).alias("t"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for row in pdf.sort_values("cluster").itertuples():
            picked: list[str] = []
            for item in row.t if row.t is not None else []:
                term = item["term"]
                if any(p.startswith(term[:4]) for p in picked):
                    continue
                picked.append(term)
                if len(picked) == 2:
                    if " ".join(picked) not in used:
                        break
                    picked.pop()
            label = " ".join(picked) or None
            if label in used:
                label = None
            used.add(label)
            out.append((row.cluster, label))
        return pd.DataFrame(out, columns=["cluster", "label"])

    every = named.select("cluster").distinct().join(best, "cluster", "left")
    return every.withColumn("of", F.lit(1)).groupBy("of").applyInPandas(run, "cluster long, label string")


def learn_topics(vectors: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """(id, cluster) of vectors (id, vector) by spherical k-means, one algorithm at every size; none of a small library."""
    n = vectors.count()
    if n < MIN_CORPUS:
        return vectors.select("id", F.lit(None).cast("long").alias("cluster")).where("false")
    return clusters.spherical_kmeans(vectors, k or choose_k(n), seed, ROUNDS)


def centroids(vectors: DataFrame, cluster: str) -> DataFrame:
    """(cluster, centroid): unit mean direction, four decimals; sums by dimension are aggregated before the shuffle."""
    parts = vectors.select(F.col(cluster).alias("cluster"), F.posexplode("vector").alias("d", "x"))
    sums = parts.groupBy("cluster", "d").agg(F.sum(F.col("x").cast("double")).alias("s"))
    listed = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda p: p["s"]).alias("v"))
    return listed.select("cluster", F.transform(normalize(F.col("v")), lambda x: F.round(x, 4)).alias("centroid"))


def cluster_stats(vectors: DataFrame, cluster: str) -> DataFrame:
    """(cluster, size, cohesion): members and their mean cosine to the centroid."""
    c = centroids(vectors, cluster)
    joined = vectors.join(F.broadcast(c), F.col(cluster) == F.col("cluster"))  # at most 30 centroids
    return joined.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg(dot(normalize(F.col("vector")), F.col("centroid"))), 5).alias("cohesion"))


def nearest_topic(vectors: DataFrame, topics: DataFrame, at_least: float = ASSIGN) -> DataFrame:
    """(id, cluster, cos) of vectors whose best of topics (cluster, centroid) is near enough; ties to the first."""
    listed = topics.agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("topics"))
    rows = vectors.select("id", normalize(F.col("vector")).alias("v")).join(F.broadcast(listed))  # one row, at most 30 centroids
    scored = F.transform("topics", lambda t: F.struct((-F.round(dot(F.col("v"), t["centroid"]), 6)).alias("minus"), t["cluster"].alias("cluster")))
    return rows.select("id", F.array_min(scored).alias("b")).select("id", "b.cluster", (-F.col("b.minus")).alias("cos")).where(F.col("cos") >= at_least)


def admitted(stats: DataFrame, labels: DataFrame, min_size: int = MIN_SIZE, cohesion: float = COHESION) -> DataFrame:
    return stats.join(labels, "cluster").where(F.col("label").isNotNull() & (F.col("size") >= min_size) & (F.col("cohesion") >= cohesion))
