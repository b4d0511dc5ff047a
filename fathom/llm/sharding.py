"""Sharding by histogram sort, in DataFrame and SQL functions alone: near equal bytes in every shard.

Rows are in the order of a key: a digest of the text, then one of the id, then the number of the row. Equal texts
stand side by side, so a group of copies lies in as few shards as its bytes allow, and a group larger than a shard is cut
between its rows. Shard j holds the rows whose byte midpoint lies in the j-th of n equal parts of all bytes.

1. The rows are written once with their keys (hexadecimal text), so that nothing after depends on how they are read again.
2. A round counts the exact bytes and rows below candidate boundaries, the prefixes of the key, in one aggregation
   that combines before its shuffle. A cell between two boundaries is refined, by more digits of the key, while a splitter
   falls inside it farther than the tolerance from both its ends, or while it has too many rows or bytes for one
   task. Only rows of such cells are counted again. Rounds end when no cell is left to refine.
3. A cell's first row and its shard follow from the counts. Rows look up their cell, level by level, and cross
   one exchange, by cell; the place in the shard is the cell's first place and the rank in the cell.

A round counts at most CELLS boundaries at first, and at most CELLS or 16 a refined cell after; there are fewer than
2 CELLS + n cells to refine (each has over a CELLS-th of all rows or bytes, or holds a splitter). So the tables of
cells, which are broadcast, have a bound that the corpus does not move, and are checked against it.

Defined results: a null text counts as empty (its row has OVERHEAD bytes); rows alike in text and id stand in the order of
their numbers, a null id before others; an empty table gives an empty result; a row larger than a share lies where its midpoint
is, so some shards may be empty, as they are where there are fewer rows than shards; texts are never cut; all
other columns, clashing names too, are passed on by :func:`sharded`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import Stage, fresh, read

SHARDS, OVERHEAD = 40, 16
#: Boundaries a round counts, and the share of all rows or bytes (one in CELLS) over which a cell is refined.
CELLS = 1 << 14
#: Cells of no more rows and bytes are left whole, however few there are of all.
CELL_ROWS, CELL_BYTES = 256, 1 << 20
#: Digits of the key: text, id, number of the row. FIRST of them are counted in the first round.
TEXT_DIGITS, ID_DIGITS, ROW_DIGITS, FIRST = 8, 8, 16, 3
DIGITS = TEXT_DIGITS + ID_DIGITS + ROW_DIGITS


def row_bytes(text: Column) -> Column:
    """Bytes of a row: its text in UTF-8, and OVERHEAD for the rest."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _key(text: Column, doc_id: Column) -> Column:
    own = F.coalesce(F.left(F.md5(doc_id.cast("string")), F.lit(ID_DIGITS)), F.lit("0" * ID_DIGITS))
    number = F.lower(F.lpad(F.hex(F.monotonically_increasing_id()), ROW_DIGITS, "0"))
    return F.concat(F.left(F.md5(F.coalesce(text, F.lit(""))), F.lit(TEXT_DIGITS)), own, number)


def _counted(rows: DataFrame, parents: DataFrame, parent_digits: int, digits: int, law: dict) -> DataFrame:
    """Cells (p, rows, bytes, at_row, at_byte, shard, open) of `digits` digits in the parents (parent, from_row, from_byte).

    rows: (key, bytes) of the parents' rows.
    """
    cells = rows.withColumns({"p": F.left("key", F.lit(digits)), "parent": F.left("key", F.lit(parent_digits))})
    cells = cells.groupBy("parent", "p").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("parent").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # the boundaries of one cell
    cells = cells.withColumns({c: F.coalesce(F.sum(x).over(before), F.lit(0)) for c, x in (("r", "rows"), ("b", "bytes"))}).join(parents, "parent")
    cells = cells.select("p", "rows", "bytes", (F.col("from_row") + F.col("r")).alias("at_row"), (F.col("from_byte") + F.col("b")).alias("at_byte"))
    n, total, slack = law["shards"], law["bytes"], law["slack"]
    # the first splitter past the start and the slack, if it lies before the end less the slack
    nth = F.expr(f"((at_byte + {slack}L) * {n}L) div {total}L") + 1
    split = (nth < n) & (nth * total < (F.col("at_byte") + F.col("bytes") - slack) * n)
    large = (F.col("rows") > law["cell_rows"]) | (F.col("bytes") > law["cell_bytes"])
    shard = F.least(F.lit(n - 1), F.expr(f"((2 * at_byte + bytes) * {n}L) div (2 * {total}L)")).cast("int")
    return cells.withColumns({"shard": shard, "open": (F.col("rows") > 1) & (split | large) & F.lit(digits < DIGITS)})


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0, text: str = "text", size: str | None = None, key: Column | None = None) -> DataFrame:
    """docs with the columns `shard` and `slot` (underscored where docs has the name), one exchange, sorted by slot.

    tolerance: the share of a shard's fair bytes by which a splitter may miss its place, so as not to cut a group or to save
    rounds; with 0 a splitter lies at the row boundary nearest to its place. size, key: docs' column of bytes and the
    order's key of DIGITS hexadecimal digits, where the caller has them already.
    """
    if shards < 1 or not 0 <= tolerance < 0.5:
        raise ValueError("there is at least one shard, and a tolerance is less than half a share")
    stage = Stage(docs.sparkSession, "shards")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), (docs[size] if size else row_bytes(docs[text])).alias("bytes"), (_key(docs[text], docs["doc_id"]) if key is None else key).alias("key"))
    keyed = stage.write(keyed, "keyed")
    held = keyed.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    law = {"shards": shards, "bytes": max(held[1], 1), "slack": int(tolerance * held[1] / shards), "cell_rows": max(CELL_ROWS, held[0] // CELLS), "cell_bytes": max(CELL_BYTES, held[1] // CELLS)}
    rows = keyed.select("key", "bytes")
    parents = docs.sparkSession.range(1).select(F.lit("").alias("parent"), F.lit(0).cast("long").alias("from_row"), F.lit(0).cast("long").alias("from_byte"))
    levels: list[tuple[int, DataFrame]] = []
    digits, more = 0, FIRST
    while True:
        counted = stage.write(_counted(rows, F.broadcast(parents), digits, digits + more, law), f"cells-{digits + more}")
        digits += more
        levels.append((digits, counted))
        open_ = counted.where("open")
        n = open_.count()
        if not n:
            break
        if n >= 2 * CELLS + shards:
            raise RuntimeError("more cells to refine than the law allows")
        parents = open_.select(F.col("p").alias("parent"), F.col("at_row").alias("from_row"), F.col("at_byte").alias("from_byte"))
        rows = keyed.select("key", "bytes").join(F.broadcast(parents.select("parent")), F.left("key", F.lit(digits)) == F.col("parent"), "left_semi")  # fewer than 2 CELLS + n
        # as many boundaries as the round may count, a digit at least
        more = 1
        while more < 4 and digits + more < DIGITS and n * 16 ** (more + 1) <= CELLS:
            more += 1
    leaves = [d.where("not open").select("p", "shard", "at_row") for _, d in levels]
    every = leaves[0]
    for leaf in leaves[1:]:
        every = every.union(leaf)
    first = every.groupBy("shard").agg(F.min("at_row").alias("first"))  # a row a shard
    found = keyed
    for i, ((digits, _), leaf) in enumerate(zip(levels, leaves)):
        cell = leaf.join(F.broadcast(first), "shard").select(F.col("p").alias(f"p{i}"), F.struct("p", "shard", (F.col("at_row") - F.col("first")).alias("base")).alias(f"c{i}"))
        found = found.join(F.broadcast(cell), F.left("key", F.lit(digits)) == F.col(f"p{i}"), "left")
    found = found.select("row", "key", F.coalesce(*[F.col(f"c{i}") for i in range(len(levels))]).alias("cell"))
    rank = F.row_number().over(Window.partitionBy("cell.p").orderBy("key"))
    placed = found.withColumn("slot", (F.col("cell.base") + rank - 1).cast("long"))
    return placed.select("row.*", F.col("cell.shard").alias(fresh(docs, "shard")), F.col("slot").alias(fresh(docs, "slot")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", row_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), _key(F.col("text"), F.col("doc_id")).alias("k"))
    out = sharded(narrow, size="size", key=F.col("k"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: By running sums over all rows in the order of the key; crc32 byte by byte over a table made from its polynomial.
SQL = """
WITH table_ AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
),
keyed AS (
    SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
           left(md5(coalesce(text, '')), 8) || coalesce(left(md5(CAST(doc_id AS VARCHAR)), 8), '00000000') AS k,
           list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), lambda x: CASE WHEN x = '' THEN NULL ELSE CAST('0x' || x AS BIGINT) END) AS bytes
    FROM documents
),
summed AS (
    SELECT doc_id, size, k, xor(4294967295, list_reduce(list_concat([4294967295], list_filter(bytes, lambda x: x IS NOT NULL)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32,
           sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total
    FROM keyed, table_
),
dealt AS (SELECT *, CAST(least(39, ((2 * before + size) * 40) // (2 * total)) AS INTEGER) AS shard FROM summed)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""
