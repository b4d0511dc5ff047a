"""A stored tree of folders and leaves that changes keep up to date, remaking only what hangs below a change.

A row of the tree (id, parent_id, title, url, ancestors, path) knows the ids of all folders above it, so what hangs below a
changed folder is found by one join, without walking the tree. Only these rows get new ancestors and paths, level by
level from the topmost that changed; all others are kept as they are.

Changes (id, seq, op, parent_id, title, url) may come in any order within a batch; `seq` alone orders them:

* created gives a node its parent, title and url (null: a folder), also anew after it was removed;
* changed gives it a title and, if there is one, a url; moved gives it a parent;
* removed takes it and all that hangs below it at that time.

A change of a node that is not there and was not created is ignored. What is no longer reached from a root is removed,
be it below a removed folder, below no folder at all, or in a circle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.held import hold
from fathom.operators.library import SEPARATOR

COLUMNS = ("id", "parent_id", "title", "url", "ancestors", "path")


def _path(parent_path: Column, title: Column, url: Column) -> Column:
    """Folders add their title to the path of their parent; leaves and folders without one have that of their parent."""
    return F.when(url.isNotNull() | (F.coalesce(title, F.lit("")) == ""), parent_path).otherwise(F.concat_ws(SEPARATOR, F.nullif(parent_path, F.lit("")), title))


def _below(rows: DataFrame, top: DataFrame, max_depth: int) -> DataFrame:
    """Rows reached from `top` with their ancestors and paths: one join a level.

    rows: (id, parent_id, title, url, link, gone); top: the first of them, with ancestors and path. A row hangs below its
    parent unless the parent was removed, and created again, after the row was put there.
    """
    found = level = top
    for _ in range(max_depth):
        above = level.where("url is null").select(F.col("id").alias("p"), F.col("ancestors").alias("pa"), F.col("path").alias("pp"), F.col("gone").alias("pg"))
        met = rows.join(above, F.col("parent_id") == F.col("p")).where("pg is null or link >= pg")
        level = hold(met.select("id", "parent_id", "title", "url", "link", "gone", F.concat("pa", F.array("p")).alias("ancestors"), _path(F.col("pp"), F.col("title"), F.col("url")).alias("path")))
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise ValueError(f"the tree has more than {max_depth} levels")


def index(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """The tree of nodes (id, parent_id, title, url); nodes that no root reaches are left out."""
    none = F.lit(None).cast("long")
    rows = nodes.select("id", "parent_id", "title", "url", none.alias("link"), none.alias("gone"))
    top = rows.where("parent_id is null").withColumns({"ancestors": F.array().cast("array<string>"), "path": _path(F.lit(""), F.col("title"), F.col("url"))})
    return _below(rows, top, max_depth).select(*COLUMNS)


def _folded(changes: DataFrame) -> DataFrame:
    """One row an id: what its changes come to. Maxima by seq, so they combine before the shuffle in any order."""
    op, seq = F.col("op"), F.col("seq")
    placed, named = op.isin("created", "moved"), op.isin("created", "changed")
    addressed = (op == "created") | (op == "changed") & F.col("url").isNotNull()
    return changes.groupBy("id").agg(
        F.max(F.when(op == "created", seq)).alias("born"),
        F.max(F.when(op == "removed", seq)).alias("gone"),
        F.max(F.when(placed, seq)).alias("link"),
        F.max_by("parent_id", F.when(placed, seq)).alias("new_parent"),
        F.max(F.when(named, seq)).alias("named"),
        F.max_by("title", F.when(named, seq)).alias("new_title"),
        F.max(F.when(addressed, seq)).alias("addressed"),
        F.max_by("url", F.when(addressed, seq)).alias("new_url"),
    )


def apply_changes(tree: DataFrame, changes: DataFrame, max_depth: int = 64) -> DataFrame:
    """(id, action, parent_id, title, url, ancestors, path) of every row that changes touch: created, updated, removed, unchanged.

    Rows of removed nodes carry what was stored. :func:`merged` gives the tree after it.
    """
    folded = hold(_folded(changes))
    own = tree.select("id", F.col("parent_id").alias("p0"), F.col("title").alias("t0"), F.col("url").alias("u0"), F.lit(True).alias("known"))
    both = folded.join(own, "id", "left").where("known or born is not null")
    alive = F.col("gone").isNull() | (F.coalesce("born", F.lit(-1)) > F.col("gone"))
    said = hold(
        both.select(
            "id",
            F.when(F.col("link").isNotNull(), F.col("new_parent")).otherwise(F.col("p0")).alias("parent_id"),
            F.when(F.col("named").isNotNull(), F.col("new_title")).otherwise(F.col("t0")).alias("title"),
            F.when(F.col("addressed").isNotNull(), F.col("new_url")).otherwise(F.col("u0")).alias("url"),
            "link",
            "gone",
            alive.alias("alive"),
        )
    )
    # all that hangs below a changed node, by the stored lists of ancestors
    below = tree.select("id", F.explode("ancestors").alias("a")).join(said.select(F.col("id").alias("a")), "a", "left_semi").select("id").distinct()
    none = F.lit(None).cast("long")
    rest = tree.join(below, "id", "left_semi").join(said, "id", "left_anti").select("id", "parent_id", "title", "url", none.alias("link"), none.alias("gone"))
    rows = hold(said.where("alive").drop("alive").unionByName(rest))
    # the topmost: rows whose parent is not among them, placed by the stored row of the parent, and roots
    firm = tree.select(F.col("id").alias("p"), "url", F.col("ancestors").alias("pa"), F.col("path").alias("pp")).where("url is null").drop("url")
    touched = said.select("id").union(rest.select("id"))
    placed = rows.join(firm.join(touched.select(F.col("id").alias("p")), "p", "left_anti"), F.col("parent_id") == F.col("p"))
    at = [*rows.columns, F.concat("pa", F.array("p")).alias("ancestors"), _path(F.col("pp"), F.col("title"), F.col("url")).alias("path")]
    roots = rows.where("parent_id is null").select("*", F.array().cast("array<string>").alias("ancestors"), _path(F.lit(""), F.col("title"), F.col("url")).alias("path"))
    now = _below(rows, hold(placed.select(*at).unionByName(roots)), max_depth).select("id", F.struct(*COLUMNS).alias("now"))
    was = tree.join(touched.distinct(), "id", "left_semi").select("id", F.struct(*COLUMNS).alias("was"))
    action = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("updated")
    row = F.coalesce("now", "was")
    return now.join(was, "id", "full").select("id", action.alias("action"), *[row[c].alias(c) for c in COLUMNS[1:]])


def merged(tree: DataFrame, delta: DataFrame) -> DataFrame:
    """The tree after the rows of :func:`apply_changes`."""
    kept = tree.join(delta.where("action <> 'unchanged'").select("id"), "id", "left_anti")
    return kept.select(*COLUMNS).unionByName(delta.where("action in ('created', 'updated')").select(*COLUMNS))


def records_after(records: DataFrame, delta: DataFrame) -> DataFrame:
    """records (id, title, url, folder_path and others) after a delta of their tree: leaves remade, removed ones gone.

    A new leaf gets nulls in the other columns; a changed title or url stays with the columns that do not derive from it.
    """
    leaves = delta.where("url is not null")
    gone = leaves.where("action = 'removed'").select("id")
    made = leaves.where("action in ('created', 'updated')").select("id", F.struct("title", "url", F.col("path").alias("folder_path")).alias("made"))
    both = records.join(gone, "id", "left_anti").join(made, "id", "full")
    derived = {"title", "url", "folder_path"}
    return both.select(*[(F.when(F.col("made").isNotNull(), F.col(f"made.{c}")).otherwise(F.col(c)).alias(c) if c in derived else F.col(c)) for c in records.columns])
