"""The engine's surface: what a user of a library calls, over batches of queries and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import crawl, embed, library, search, store, sweep, tags
from fathom.operators.prefs import Prefs


class Engine:
    """Records, vectors and clicks as DataFrames; every method returns a DataFrame and changes nothing in place."""

    def __init__(self, spark: SparkSession, records: DataFrame, vectors: DataFrame | None = None, clicks: DataFrame | None = None, provider: embed.EmbeddingProvider | None = None, prefs: Prefs | None = None):
        self.spark, self.records, self.vectors, self.clicks = spark, records, vectors, clicks
        self.provider, self.prefs = provider or embed.HashingProvider(), prefs or Prefs()
        self.undo: DataFrame | None = None
        self.undo_vectors: DataFrame | None = None

    def _with(self, **changes) -> Engine:
        kept = {n: getattr(self, n) for n in ("records", "vectors", "clicks", "provider", "prefs")}
        return Engine(self.spark, **kept | changes)

    def embed_queries(self, texts: list[str]) -> DataFrame:
        rows = [(i, t, [float(x) for x in self.provider.embed_query(t)]) for i, t in enumerate(texts)]
        return self.spark.createDataFrame(rows, "query_id long, text string, vector array<double>")

    def search(self, queries: DataFrame, weights: dict | None = None, personalized: bool = True, now_ms: int | None = None) -> DataFrame:
        """Ranked hits of (query_id, text, vector); re-ranked by clicks where there are any. Without vectors lexical only."""
        semantic = self.vectors if "vector" in queries.columns else None
        hits = search.hybrid(self.records, semantic, queries, search.Weights.of(weights))
        if not personalized or self.clicks is None or now_ms is None:
            return hits
        return search.boosted(hits, search.click_signals(self.clicks, queries, now_ms), self.records)

    def browse(self, sort: str = "recent", folder: str | None = None) -> DataFrame:
        clicks = self.clicks if self.clicks is not None else self.spark.createDataFrame([], "record_id string, ts long")
        return search.browse(self.records, clicks, sort, folder)

    def suggest(self, queries: DataFrame) -> DataFrame:
        return search.suggestions(self.search(queries), self.records, queries)

    def open_result(self, click: DataFrame) -> Engine:
        """With the click appended; the newest 2000 stay."""
        clicks = click if self.clicks is None else self.clicks.unionByName(click)
        return self._with(clicks=store.newest(clicks, "click_id"))

    def delete(self, record_id: str) -> Engine:
        keys = self.spark.createDataFrame([(record_id,)], "id string")
        out = self._with(records=store.delete(self.records, keys), vectors=None if self.vectors is None else store.delete(self.vectors, keys))
        out.undo = self.records.where(F.col("id") == record_id)
        out.undo_vectors = None if self.vectors is None else self.vectors.where(F.col("id") == record_id)
        return out

    def undo_delete(self) -> Engine:
        back = self.records if self.undo is None else store.upsert(self.records, self.undo)
        vectors = self.vectors if self.vectors is None or self.undo_vectors is None else store.upsert(self.vectors, self.undo_vectors)
        return self._with(records=back, vectors=vectors)

    def reveal(self, record_id: str) -> DataFrame:
        return self.records.where(F.col("id") == record_id).select("id", "folder_path")

    def state(self) -> DataFrame:
        return library.health(self.records, self.vectors if self.vectors is not None else self.spark.createDataFrame([], "id string"))

    def ingest(self, now: DataFrame) -> Engine:
        """After a pass over the current tree: rows rebuilt, those no longer there gone, vectors with them."""
        rebuilt = library.rebuild(now, self.records)
        gone = None if self.vectors is None else self.vectors.join(rebuilt.select("id"), "id", "left_semi")
        return self._with(records=rebuilt, vectors=gone)

    def ingest_tree(self, nodes: DataFrame) -> Engine:
        """After a pass over nodes (id, parent_id, title, url, date_added); excluded folders go with all below them."""
        return self.ingest(library.leaves(nodes, list(self.prefs.excluded)))

    def set_prefs(self, message: dict, nodes: DataFrame | None = None) -> Engine:
        """With the preferences of a message, coerced; where the tree is given, a pass over it takes out or brings back what they concern."""
        changed = self._with(prefs=Prefs.of(message))
        return changed if nodes is None else changed.ingest_tree(nodes)

    def reset(self) -> Engine:
        """Every table empty, the preferences at their defaults, nothing to undo."""
        none = lambda df: None if df is None else df.limit(0)
        return self._with(records=none(self.records), vectors=none(self.vectors), clicks=none(self.clicks), prefs=Prefs())

    def tag(self, tag_vectors: DataFrame, threshold: float = tags.THRESHOLD) -> DataFrame:
        return tags.zero_shot(self.vectors, tag_vectors, threshold)

    def topics(self, cluster: str = "cluster") -> DataFrame:
        return tags.cluster_stats(self.vectors, cluster)

    def crawl_waves(self) -> DataFrame:
        """Nothing is crawled where the preferences forbid it."""
        return crawl.waves(self.records.where((F.col("status") == "pending") & F.lit(self.prefs.crawl_enabled)))

    def rank_of(self, queries: DataFrame, record_id: str) -> DataFrame:
        return self.search(queries).where(F.col("id") == record_id).select("query_id", "rank")

    def tag_scores(self, record_id: str, tag_vectors: DataFrame) -> DataFrame:
        return tags.zero_shot(self.vectors.where(F.col("id") == record_id), tag_vectors, threshold=-1.0, best=12)

    def evaluate(self, queries: DataFrame, expected: DataFrame) -> DataFrame:
        return search.evaluate(self.search(queries), expected, self.records, queries)

    def tune(self, queries: DataFrame, expected: DataFrame) -> DataFrame:
        return sweep.sweep(self.records, self.vectors, queries, expected)
