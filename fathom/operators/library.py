"""Ingest of a link tree: flattening, folder paths and counts, and the difference from what is stored."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import html, text, url
from fathom.functions.records import SIGNALS, optional

SEPARATOR, COMPOSITE_CHARS, HEADINGS, EXCERPT_WORDS = " / ", 2000, 5, 300


def flatten(nodes: DataFrame, excluded: list[str] | None = None, max_depth: int = 64) -> DataFrame:
    """(id, path, depth, is_leaf) of every node below the roots of nodes (id, parent_id, title, url).

    Folders named in excluded go with all below them. One join a level, which is held for the next; the levels end when
    one is empty, and a tree deeper than max_depth raises.
    """
    kept = nodes.where(~F.col("id").isin(excluded)) if excluded else nodes
    level = kept.where("parent_id is null").select("id", F.coalesce("title", F.lit("")).alias("path"), F.lit(0).alias("depth"), F.col("url").isNotNull().alias("is_leaf"))
    found = level
    for depth in range(1, max_depth + 1):
        below = kept.alias("c").join(level.where("not is_leaf").alias("p"), F.col("c.parent_id") == F.col("p.id"))
        own = F.when(F.col("c.url").isNotNull() | (F.coalesce("c.title", F.lit("")) == ""), F.col("p.path")).otherwise(F.concat_ws(SEPARATOR, F.nullif("p.path", F.lit("")), "c.title"))
        level = below.select("c.id", own.alias("path"), F.lit(depth).alias("depth"), F.col("c.url").isNotNull().alias("is_leaf")).persist(StorageLevel.MEMORY_AND_DISK)
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise ValueError(f"the tree has more than {max_depth} levels")


def leaves(nodes: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(id, url, canonical_url, title, folder_path, date_added) of the leaves of nodes, without those in or below excluded folders."""
    kept = flatten(nodes, excluded).where("is_leaf").select("id", F.col("path").alias("folder_path"))
    return nodes.join(kept, "id").select("id", "url", url.canonical(F.col("url")).alias("canonical_url"), F.coalesce("title", F.lit("")).alias("title"), "folder_path", "date_added")


def folder_counts(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """(id, n): leaves below each folder, at any depth; folders without any are left out."""
    up = nodes.where("url is null").select("id", "parent_id")
    at = nodes.where("url is not null and parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    total = at
    for _ in range(max_depth):
        at = at.join(up, "id").where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        if at.isEmpty():
            return total.groupBy("id").agg(F.sum("n").alias("n"))
        total = total.unionByName(at)
    raise ValueError(f"the tree has more than {max_depth} levels")


def composite_text(title, page_url, folder, og_title=None, description=None, site=None, headings=None, excerpt=None):
    """One text a record: seven sections, parts said before (in any case) left out, at most 2000 characters."""
    none = F.lit(None).cast("string")
    heads = F.slice(text.distinct_ignoring_case(headings), 1, HEADINGS) if headings is not None else F.array().cast("array<string>")
    sections = [
        F.array(title, og_title if og_title is not None else none),
        F.array(description if description is not None else none),
        F.array(site if site is not None else none, url.domain(page_url)),
        heads,
        F.array(text.cap_words(excerpt, EXCERPT_WORDS) if excerpt is not None else none),
        F.array(F.array_join(url.tokens(page_url), " ")),
        F.array(folder),
    ]
    parts = F.flatten(F.array(*[_numbered(s, i) for i, s in enumerate(sections)]))
    filled = F.filter(parts, lambda x: F.coalesce(x["p"], F.lit("")) != "")
    empty = F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit("").alias("p"))), lambda x: F.lit(False))
    unique = F.aggregate(filled, empty, lambda out, x: F.when(F.exists(out, lambda y: F.lower(y["p"]) == F.lower(x["p"])), out).otherwise(F.concat(out, F.array(x))))

    def joined(out):
        lines = F.transform(F.sequence(F.lit(0), F.lit(len(sections) - 1)), lambda i: F.array_join(F.transform(F.filter(out, lambda y: y["s"] == i), lambda y: y["p"]), " "))
        return F.left(F.array_join(F.filter(lines, lambda line: line != ""), "\n"), F.lit(COMPOSITE_CHARS))

    return joined(unique)


def _numbered(section, i: int):
    return F.transform(section, lambda p: F.struct(F.lit(i).alias("s"), text.trim(p).alias("p")))


def with_composite(records: DataFrame) -> DataFrame:
    og_title, description, site, headings, excerpt = (optional(records, c, kind) for c, kind in SIGNALS.items())
    filled = F.coalesce(headings, F.array().cast("array<string>"))
    made = composite_text(F.col("title"), F.col("url"), F.col("folder_path"), og_title, description, site, filled, excerpt)
    return records.withColumn("composite_text", made).withColumn("content_hash", text.content_hash(F.col("composite_text")))


def diff(now: DataFrame, stored: DataFrame, compared: tuple[str, ...] = ("url", "canonical_url", "title", "folder_path")) -> DataFrame:
    """(id, action): created, updated, unchanged or stale, from one full outer join by key."""
    a = now.select("id", F.struct(*compared).alias("now"))
    b = stored.select("id", F.struct(*compared).alias("stored"))
    action = F.when(F.col("stored").isNull(), "created").when(F.col("now").isNull(), "stale").when(F.col("now").eqNullSafe(F.col("stored")), "unchanged").otherwise("updated")
    return a.join(b, "id", "full").select("id", action.alias("action"))


def summary(actions: DataFrame) -> DataFrame:
    return actions.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("created", "created"), ("updated", "updated"), ("stale", "removed_stale"))])


def rebuild(now: DataFrame, stored: DataFrame, reembed: bool = False) -> DataFrame:
    """Records after a pass: signals, tags and status of stored rows stay, new rows have none and are pending, learned tags go.

    A changed text keeps its model version, as vectors of renamed records stay, unless reembed asks for new ones. A tag
    stamp stays while the title does.
    """
    carried = [c for c in (*SIGNALS, "tags") if c in stored.columns]
    stamps = [c for c in ("model_version", "tag_model_version") if c in stored.columns]
    old = with_composite(stored).select("id", F.col("title").alias("t0"), F.col("content_hash").alias("h0"), F.col("status").alias("s0"), F.col("date_added").alias("d0"), *carried, *stamps)
    both = now.select("id", "url", "canonical_url", "title", "folder_path", "date_added").join(old, "id", "left")
    both = with_composite(both.withColumn("date_added", F.coalesce("date_added", "d0")))
    if "tags" in carried:
        both = both.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    if "model_version" in stamps and reembed:
        both = both.withColumn("model_version", F.when(F.col("content_hash") == F.col("h0"), F.col("model_version")))
    if "tag_model_version" in stamps:
        both = both.withColumn("tag_model_version", F.when(F.col("title") == F.col("t0"), F.col("tag_model_version")))
    return both.withColumn("status", F.coalesce("s0", F.lit("pending"))).drop("t0", "h0", "s0", "d0")


def signals(pages: DataFrame) -> DataFrame:
    """(page_id, title, og_title, description, site, n_links) of pages (page_id, url, html), by pattern."""
    h = F.col("html")
    return pages.select("page_id", html.title(h).alias("title"), html.meta(h, "og:title").alias("og_title"), F.coalesce(html.meta(h, "og:description"), html.meta(h, "description")).alias("description"), html.meta(h, "og:site_name").alias("site"), F.size(html.links(h)).cast("long").alias("n_links"))


def health(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: records, by status, with headings, descriptions, excerpts, tags and learned tags, embedded."""
    own = records.join(vectors.select("id", F.lit(1).alias("v")).distinct(), "id", "left")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("full", "meta_only", "baseline", "pending", "dead")]
    filled = {"with_description": "meta_description", "with_excerpt": "excerpt"}
    counts += [F.count_if(F.coalesce(optional(records, c), F.lit("")) != "").alias(n) for n, c in filled.items()]
    listed = {"with_headings": "headings", "tagged": "tags", "learned": "learned_tags"}
    counts += [F.count_if(F.coalesce(F.size(optional(records, c, "array<string>")), F.lit(0)) > 0).alias(n) for n, c in listed.items()]
    return own.agg(F.count("*").alias("records"), *counts, F.count("v").alias("embedded"))
