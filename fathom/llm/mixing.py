"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

A source has an integer number of units, its target weight. All sources that have blocks left share each slot in
proportion to their units: at virtual time v a source with `a` units and B blocks has had the share min(a v, B), and the
slot is t(v), the sum of all shares. Its i-th block (from 0) is released at floor t(i / a) and due at
ceil t((i + 1) / a); in each slot the released block with the earliest deadline goes, ties to the first source by name.
Between two whole slots the shares add up to the slots between them, so every block meets its deadline, and after any
number of slots each source is within less than one block of its share, to the last block of the last source.

At whole virtual times all shares are whole, so the rounds [v, v + 1) are scheduled one by one, and alike rounds once:
a source's demand changes only in the round in which it runs out, and after it. There are at most 2 S + 1 kinds
of round for S sources, each of at most D slots (the sum of units), however many rows there are; a row finds its slot
from its block's number in its source alone.

A source's rows are dealt out in the order of a hash. The order's rank comes from counts of hash ranges (chunks, summed
in two levels), aggregated before the shuffle, and a window over one chunk of one source, so a source with a third of
all rows is spread over as many tasks as it has chunks.

Every row is kept; when a source runs out, the others go on at their weights. Defined results: a null source
is a source of its own; rows that repeat are rows of their own (equal ones in any order); a null doc_id is
ordered first; a source not named in `units` has one unit, a named one without rows takes no part; an empty
table gives an empty result; texts, null, empty or very long ones, are not looked at; other columns, clashing names
too, are passed on by :func:`mixed`. The list of sources, not of rows, is held as one row: it is the mixture's recipe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import fresh, read

BLOCK_ROWS, UNITS, CHUNK_ROWS = 4, 100, 2_000
#: Chunks whose counts one task adds up.
GROUP = 1000


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def tempered(counts: DataFrame, total: int) -> DataFrame:
    """Units in proportion to the square root of a source's rows, at least 1: large sources give way to small ones."""
    roots = counts.agg(F.sum(F.sqrt("rows")).alias("roots"))
    return counts.join(F.broadcast(roots)).withColumn("a", F.greatest(F.lit(1), F.floor(F.lit(total) * F.sqrt("rows") / F.col("roots") + 0.5)).cast("long")).drop("roots")  # one row


#: The share of all sources, times the units of source s, when it has had x of its blocks in the round.
_FLUID = "aggregate(sequence(0, size(demand) - 1), 0L, (t, u) -> t + least(demand[u] * a[s], a[u] * ({x})))"

#: Release and deadline of each block of each source in one round.
_WINDOWS = f"""
transform(demand, (d, s) -> transform(if(d > 0, sequence(0L, d - 1), cast(array() as array<bigint>)), i -> named_struct(
  'release', ({_FLUID.format(x="i")}) div a[s],
  'deadline', ({_FLUID.format(x="i + 1")} + a[s] - 1) div a[s])))
"""

#: Earliest deadline first over one round. windows: those of each source's blocks; slots: the number of all blocks.
_EDF = """
aggregate(
  sequence(0L, slots - 1),
  named_struct('given', transform(demand, d -> 0L), 'order', cast(array() as array<struct<source: bigint, i: bigint>>)),
  (state, t) -> transform(
    array(array_min(transform(windows, (w, s) -> if(
      state.given[s] < demand[s] and get(w, cast(state.given[s] as int)).release <= t,
      named_struct('due', get(w, cast(state.given[s] as int)).deadline, 's', cast(s as bigint)),
      null)))),
    next -> named_struct(
      'given', transform(state.given, (g, s) -> if(s = next.s, g + 1, g)),
      'order', concat(state.order, array(named_struct('source', next.s, 'i', state.given[cast(next.s as int)]))))
  )[0],
  state -> state.order)
"""


def timetable(blocks: DataFrame) -> DataFrame:
    """Slots of every kind of round, from (key, blocks, a): blocks and units of each source.

    Rows: (key, i, first, past, start, slots, at, release, deadline): block i of the source's round goes in slot `at`
    of rounds first <= round < past, whose slots begin at start + (round - first) * slots.
    """
    one = blocks.agg(F.array_sort(F.collect_list(F.struct("key", "blocks", "a"))).alias("s"))
    turns = F.array_sort(F.array_distinct(F.flatten(F.expr("concat(array(array(0L)), transform(s, x -> array(x.blocks div x.a, x.blocks div x.a + 1)))"))))
    kinds = one.select("s", turns.alias("turns")).select("s", "turns", F.posexplode("turns").alias("kind", "first"))
    kinds = kinds.select(
        "s",
        "first",
        F.expr("get(turns, kind + 1)").alias("past"),
        F.expr("transform(s, x -> least(x.a, greatest(0L, x.blocks - first * x.a)))").alias("demand"),
        F.expr("aggregate(s, 0L, (t, x) -> t + least(x.blocks, first * x.a))").alias("start"),
    ).withColumn("slots", F.expr("aggregate(demand, 0L, (t, d) -> t + d)"))
    # a task a few kinds of round; a round's windows are made once and then looked up slot by slot
    going = kinds.where("slots > 0").withColumn("a", F.expr("transform(s, x -> x.a)")).repartition(blocks.sparkSession.sparkContext.defaultParallelism, "first")
    round_ = F.expr(f"transform(array({_WINDOWS}), windows -> named_struct('windows', windows, 'order', {_EDF}))[0]")
    going = going.select("s", "first", "past", "start", "slots", round_.alias("r")).select("s", "first", "past", "start", "slots", "r.windows", "r.order")
    slot = going.select("s", "first", "past", "start", "slots", "windows", F.posexplode("order").alias("at", "o"))
    own = F.expr("get(windows[cast(o.source as int)], cast(o.i as int))")
    return slot.select(F.expr("s[cast(o.source as int)].key").alias("key"), F.expr("o.i").alias("i"), "first", "past", "start", "slots", F.col("at").cast("long").alias("at"), own["release"].alias("release"), own["deadline"].alias("deadline"))


def schedule(docs: DataFrame, units: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, total: int = UNITS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """docs (doc_id, source and any other columns) with a struct column that places each row in the mixture.

    The struct, `mix` (underscored where docs has the name): block (of the source, from 0), slot (of the whole
    mixture), place (in the block), release and deadline (of the block, in slots: release <= slot < deadline).
    """
    if block_rows < 1 or units is not None and any(u < 1 for u in units.values()):
        raise ValueError("block_rows and units are at least 1")
    name = fresh(docs, "mix")
    # the caller's columns travel as one struct, so none of theirs can clash with ours
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).select("row", _source_key(F.col("row.source")).alias("key"), F.md5(F.col("row.doc_id").cast("string")).alias("h"))
    counts = rows.groupBy("key").agg(F.count("*").alias("rows"))
    if not units:
        weighed = tempered(counts, total)
    else:
        listed = F.create_map(*[F.lit(x) for k, u in units.items() for x in ("s" + k, u)])
        weighed = counts.withColumn("a", F.coalesce(F.try_element_at(listed, F.col("key")), F.lit(1)).cast("long"))
    weighed = weighed.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("long"))
    most = counts.agg(F.max("rows")).first()[0] or 0
    chunks = max(1, -(-most // chunk_rows))
    chunked = rows.withColumn("chunk", F.coalesce(F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * chunks / 2.0**32), F.lit(0)).cast("int"))
    # rows before a chunk: those of the groups of chunks before its own, and of the chunks before it in its group
    group = F.floor(F.col("chunk") / GROUP).cast("int")
    each = chunked.groupBy("key", "chunk").agg(F.count("*").alias("n")).withColumn("group", group)
    inside = Window.partitionBy("key", "group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # at most GROUP rows
    across = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    groups = each.groupBy("key", "group").agg(F.sum("n").alias("n")).select("key", "group", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("past"))
    sizes = each.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, ["key", "group"]).select("key", "chunk", (F.col("past") + F.col("own")).alias("base"))
    sizes = sizes.join(weighed.select("key", "a"), "key")
    within = Window.partitionBy("key", "chunk").orderBy("h", "row.doc_id")
    ranked = chunked.withColumn("nth", F.row_number().over(within)).join(sizes, ["key", "chunk"]).withColumn("r", F.col("base") + F.col("nth") - 1)
    placed = ranked.select("row", "key", "a", F.expr(f"r div {block_rows}L").alias("block"), F.expr(f"r % {block_rows}L").alias("place"))
    placed = placed.withColumns({"round": F.expr("block div a"), "i": F.expr("block % a")})
    table = timetable(weighed)
    meets = (placed["key"] == table["key"]) & (placed["i"] == table["i"]) & (placed["round"] >= table["first"]) & (placed["round"] < F.coalesce(table["past"], F.lit(1 << 62)))
    begin = F.col("start") + (F.col("round") - F.col("first")) * F.col("slots")
    place = F.struct(
        "block",
        (begin + F.col("at")).alias("slot"),
        "place",
        (begin + F.col("release")).alias("release"),
        (begin + F.col("deadline")).alias("deadline"),
    )
    return placed.join(table.alias("t"), meets).select("row.*", place.alias(name))


def ordered(docs: DataFrame, units: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`schedule`, range-partitioned by slot and place and sorted."""
    name = fresh(docs, "mix")
    order = [F.col(f"{name}.slot"), F.col(f"{name}.place")]
    return schedule(docs, units, block_rows).repartitionByRange(*order).sortWithinPartitions(*order)


def mixed(docs: DataFrame, units: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns of docs in the order of the mixture, range-partitioned by slot and sorted.

    The order is that of this plan; a reader of several written files may change it. Rows with distinct ids get the
    same slots from :func:`schedule` and :func:`ordered` whatever order they are read in.
    """
    return ordered(docs, units, block_rows).select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(read(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "mix.*")


#: From the definition, slot by slot over all sources' blocks, without rounds.
SQL = """
WITH RECURSIVE rows_ AS (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents
),
counts AS (SELECT key, count(*) AS n FROM rows_ GROUP BY key),
weighed AS (
    SELECT key, CAST((n + 3) // 4 AS BIGINT) AS blocks,
           CAST(greatest(1, floor(100 * sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) + 0.5)) AS BIGINT) AS a
    FROM counts
),
placed AS (
    SELECT doc_id, source, key, (nth - 1) // 4 AS block, (nth - 1) % 4 AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h, doc_id) AS nth FROM rows_)
),
numbered AS (SELECT *, unnest(range(blocks)) AS i FROM weighed),
windows AS (
    SELECT n.key, n.i, CAST(sum(least(u.blocks * n.a, u.a * n.i)) // n.a AS BIGINT) AS release,
           CAST((sum(least(u.blocks * n.a, u.a * (n.i + 1))) + n.a - 1) // n.a AS BIGINT) AS deadline
    FROM numbered n CROSS JOIN weighed u GROUP BY n.key, n.i, n.a
),
listed AS (SELECT key, list(release ORDER BY i) AS r, list(deadline ORDER BY i) AS d FROM windows GROUP BY key),
edf AS (
    SELECT CAST(-1 AS BIGINT) AS t, (SELECT list({'key': key, 'r': r, 'd': d, 'g': CAST(0 AS BIGINT)} ORDER BY key) FROM listed) AS s, CAST(NULL AS VARCHAR) AS went, CAST(NULL AS BIGINT) AS i
    UNION ALL
    SELECT t + 1, list_transform(s, lambda x: {'key': x.key, 'r': x.r, 'd': x.d, 'g': x.g + CASE WHEN x.key = best.key THEN 1 ELSE 0 END}), best.key, best.g
    FROM (
        SELECT *, list_min(list_transform(list_filter(s, lambda x: x.g < len(x.r) AND x.r[x.g + 1] <= t + 1), lambda x: {'due': x.d[x.g + 1], 'key': x.key, 'g': x.g})) AS best
        FROM edf WHERE t + 1 < (SELECT sum(blocks) FROM weighed)
    )
)
SELECT p.doc_id, p.source, CAST(p.block AS BIGINT) AS block, CAST(e.t AS BIGINT) AS slot, CAST(p.place AS BIGINT) AS place, w.release, w.deadline
FROM placed p JOIN edf e ON e.went = p.key AND e.i = p.block JOIN windows w ON w.key = p.key AND w.i = p.block
"""
