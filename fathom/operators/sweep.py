"""Weight sweeps: the ranking of every query under every combination of weights, in one plan."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators import search

#: The grid.
LEXICAL, BLEND, SHARPNESS = (0.45, 0.55, 0.65), (0.4, 0.6, 0.8, 1.0), (2.0, 5.0, 10.0, 15.0)


def sweep(records: DataFrame, vectors: DataFrame, queries: DataFrame, expected: DataFrame, floor: float = 0.5, best: int = 8, limit: int = search.Weights.limit) -> DataFrame:
    """(lexical, blend, sharpness, hits, mrr) of the best combinations by hits, then reciprocal rank.

    Scores are computed once; only the fusion differs, on the candidates of each query. Both figures are over all
    expected queries, of which the first `limit` rows of the ranking count: a query without a hit counts 0.
    """
    lex = search.lexical(records, queries).select("query_id", "id", "lex")
    within = Window.partitionBy("query_id")
    ranks = search.cosines(vectors, search.prepared(queries), floor).withColumns({"place": F.row_number().over(within.orderBy(F.desc("cos"), "id")), "top": F.max("cos").over(within)})
    known = records.select("id", "title", "url")
    both = lex.join(ranks, ["query_id", "id"], "full").join(known, "id")
    grid = F.array(*[F.struct(F.lit(a).alias("lexical"), F.lit(b).alias("blend"), F.lit(s).alias("sharpness")) for a, b, s in product(LEXICAL, BLEND, SHARPNESS)])
    each = both.withColumn("w", F.explode(grid))
    magnitude = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("cos") - floor) / F.nullif(F.col("top") - floor, F.lit(0.0)))), F.lit(0.0))
    sem = F.when(F.col("cos").isNull(), 0.0).otherwise(F.col("w.blend") * (F.col("w.sharpness") + 1) / (F.col("w.sharpness") + F.col("place")) + (1 - F.col("w.blend")) * magnitude)
    scored = each.select("query_id", "id", "title", "url", "w.*", F.round(F.col("w.lexical") * F.coalesce("lex", F.lit(0.0)) + (1 - F.col("w.lexical")) * sem, 6).alias("score")).where("score >= 0.05")
    order = Window.partitionBy("lexical", "blend", "sharpness", "query_id").orderBy(F.desc("score"), F.lower("title"), "title", "id")
    good = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).join(expected, "query_id").where(F.exists("expect", lambda e: F.contains(F.lower("url"), F.lower(e))))
    firsts = good.groupBy("lexical", "blend", "sharpness", "query_id").agg(F.min("rank").alias("first"))
    every = expected.select("query_id", "k", F.explode(grid).alias("w")).select("query_id", "k", "w.*").join(firsts, ["lexical", "blend", "sharpness", "query_id"], "left")
    total = every.groupBy("lexical", "blend", "sharpness").agg(F.count_if(F.col("first") <= F.col("k")).alias("hits"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
    return total.orderBy(F.desc("hits"), F.desc("mrr"), "lexical", "blend", "sharpness").limit(best)
