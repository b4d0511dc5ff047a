"""Fill-in-the-middle transformation of whole texts in DuckDB, a batch of rows at a time inside mapInArrow.

A text is cut into lines. Two hashes of the row's id place the cuts between prefix, middle and suffix, on line boundaries; two more
choose whether the text is changed and in what order its parts go. All of it is one SQL statement over the registered
batch: lines by ``regexp_extract_all``, parts by ``list_slice`` and ``array_to_string``, choices by ``sha256``. No row is
touched by Python, rows are not moved between tasks, and a lost task is run again with the same result.

A text that holds a sentinel stays plain, so the sentinels of an output are those set here, and the exact text is
rebuilt from output and form by :data:`RESTORED`.

Defined results: a null text counts as empty; an empty text stays plain; a null id is hashed as no digits; repeated rows
give repeated results; an empty table gives an empty result; very long texts are whole in one task, the others of their
batch apart from them; all other columns, clashing names too, are passed on by :func:`transformed`.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import fresh, in_batches, read

SEED, PERCENT, SPM_PERCENT = "7", 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
#: Bytes of text that DuckDB is given at once, a row at least, and its memory.
BATCH_BYTES, MEMORY = 4_000_000, "512MB"

#: From `batch` (doc_id, text): the outputs, row by row in order, with the text they are made of as `source_text`.
TRANSFORM = f"""
WITH numbered AS (
    SELECT row_number() OVER () AS nth, coalesce(text, '') AS t, sha256('{{seed}}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch
),
cut AS (
    SELECT nth, t, regexp_extract_all(t, '{LINES}') AS lines,
           list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substring(h, i, 8) AS BIGINT)) AS h
    FROM numbered
),
placed AS (
    SELECT nth, t, lines, len(lines) AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS a, greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= {{percent}} THEN 'plain' WHEN h[4] % 100 < {{spm}} THEN 'spm' ELSE 'psm' END AS form
    FROM cut
),
parts AS (
    SELECT nth, t, n, form, array_to_string(list_slice(lines, 1, a), '') AS prefix, array_to_string(list_slice(lines, a + 1, b), '') AS middle, array_to_string(list_slice(lines, b + 1, n), '') AS suffix
    FROM placed
),
made AS (
    SELECT nth, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                     ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
    FROM parts
)
"""

#: The exact text from `output` and `form`.
RESTORED = f"""
CASE form WHEN 'plain' THEN output
     WHEN 'psm' THEN substring(split_part(output, '{SUFFIX}', 1), {len(PREFIX) + 1}) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{SUFFIX}', 2), '{MIDDLE}', 1)
     ELSE split_part(split_part(output, '{PREFIX}', 2), '{MIDDLE}', 1) || split_part(output, '{MIDDLE}', 2) || substring(split_part(output, '{PREFIX}', 1), {len(SUFFIX) + 1}) END
"""


@lru_cache(maxsize=1)
def _engine():
    """One in-memory DuckDB a Python worker, on one thread."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})


def _asked(batch: pa.RecordBatch, query: str) -> pa.Table:
    engine = _engine()
    engine.register("batch", pa.table({"doc_id": batch.column("doc_id"), "text": batch.column("text")}))
    try:
        return engine.sql(query).to_arrow_table()
    finally:
        engine.unregister("batch")


def _columns(table: pa.Table, schema: T.StructType) -> list[pa.Array]:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return [table.column(i).cast(kinds[f.dataType.simpleString()]).combine_chunks() for i, f in enumerate(schema.fields)]


def transformed(docs: DataFrame, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, seed: str = SEED) -> DataFrame:
    """docs with fim_form, fim_text, fim_prefix_chars and fim_middle_chars (underscored where docs has the name).

    percent: how many texts of a hundred are changed; spm_percent: how many of these have the suffix first.
    """
    kinds = {"fim_form": T.StringType(), "fim_text": T.StringType(), "fim_prefix_chars": T.LongType(), "fim_middle_chars": T.LongType()}
    added = T.StructType([T.StructField(fresh(docs, name), kind) for name, kind in kinds.items()])
    query = TRANSFORM.format(seed=seed.replace("'", "''"), percent=int(percent), spm=int(spm_percent)) + "SELECT form, output, prefix_chars, middle_chars FROM made ORDER BY nth"

    def run(batches):
        for batch in in_batches(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(_asked(batch, query), added)], [*batch.schema.names, *added.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def restored(rows: DataFrame, output: str = "fim_text", form: str = "fim_form", into: str = "restored") -> DataFrame:
    """rows with the exact text that each output was made of."""
    added = T.StructType([T.StructField(fresh(rows, into), T.StringType())])
    query = f"WITH made AS (SELECT row_number() OVER () AS nth, doc_id AS form, text AS output FROM batch) SELECT {RESTORED} FROM made ORDER BY nth"

    def run(batches):
        for batch in in_batches(batches, output, BATCH_BYTES):
            pair = pa.RecordBatch.from_arrays([batch.column(form), batch.column(output)], ["doc_id", "text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(_asked(pair, query), added)], [*batch.schema.names, *added.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


DIGEST = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output_sha256", T.StringType()),
        T.StructField("restored_sha256", T.StringType()),
    ]
)


def digests(docs: DataFrame, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): outputs are made, hashed and undone in one pass."""
    query = TRANSFORM.format(seed=seed.replace("'", "''"), percent=int(percent), spm=int(spm_percent))
    query += f"SELECT n, form, prefix_chars, middle_chars, sha256(output), sha256({RESTORED}) FROM made ORDER BY nth"

    def run(batches):
        for batch in in_batches(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_columns(_asked(batch, query), DIGEST)], ["doc_id", *DIGEST.names])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *DIGEST.fields]))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


#: By positions of line ends instead of lists of lines, and without undoing: the restored text is the text itself.
SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
ended AS (
    SELECT doc_id, t, h, list_transform(string_split(t, chr(10)), lambda x: length(x) + 1) AS sizes, CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 1 ELSE 0 END AS bare FROM hashed
),
counted AS (
    SELECT doc_id, t, sizes, len(sizes) - bare AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(sizes) - bare + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(sizes) - bare + 1) AS y,
           CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM ended
),
placed AS (
    SELECT *, CAST(least(length(t), coalesce(list_sum(sizes[1:least(x, y)]), 0)) AS BIGINT) AS p, CAST(least(length(t), coalesce(list_sum(sizes[1:greatest(x, y)]), 0)) AS BIGINT) AS m FROM counted
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN p END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN m - p END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, p) || '<S>' || substring(t, m + 1) || '<M>' || substring(t, p + 1, m - p)
                        ELSE '<S>' || substring(t, m + 1) || '<P>' || left(t, p) || '<M>' || substring(t, p + 1, m - p) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM placed
"""
