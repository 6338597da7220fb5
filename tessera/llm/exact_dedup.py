"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text into two cells of a counting filter. Cells are counted in each task first, so that what moves is a number a cell and task,
never a text; the cells that were hit at least twice become a bit table of bounded size, which is stored once. Pass two probes it: a row of which a
cell was hit once only has no equal and passes straight through; the others ("possibly repeated") shuffle by SHA-256 and are grouped exactly. False
positives cost a little shuffle, never a row. The table's bound is reached at 2^26 rows; beyond it fills up and more rows shuffle, so that at 2^30 rows
most do.

Defined results: a null text counts as empty; a null id never wins against another id; rows that repeat both text and id are the same
document, of which one stays; an empty table gives an empty result; other columns are carried and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_cells, bit_table, cell_count, join_groups, probe, quoted, stored


def _flagged(docs: DataFrame, text: str, into: str) -> DataFrame:
    """The rows with ``into`` (false: certainly no equal text). The bit table is stored: every use of the rows probes the same."""
    cells = cell_count(docs.count())
    hashed = F.xxhash64(F.coalesce(quoted(text), F.lit("")))
    pairs = docs.select(F.explode(F.array(*bit_cells(hashed, cells))).alias("cell"))
    repeated = pairs.groupBy("cell").agg(F.count("*").alias("n")).filter("n >= 2")
    return probe(docs, stored(bit_table(repeated), "exact-cells"), bit_cells(hashed, cells), into)


def _digest(text: str):
    return F.sha2(F.coalesce(quoted(text), F.lit("")), 256)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    flagged = stored(_flagged(rows, "text", "repeated").select("doc_id", _digest("text").alias("text_sha256"), "repeated"), "exact-flags")
    once = flagged.filter("NOT repeated").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # Equal (text, id) rows collapse before the shuffle and come back by explode: a hot text costs its distinct ids only.
    members = stored(flagged.filter("repeated").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n")), "exact-members")
    groups = members.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    total = members.agg(F.sum("n")).first()[0] or 0
    joined = join_groups(members, stored(groups, "exact-groups"), "text_sha256", "group_size", total)
    again = joined.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256"
    )
    return once.unionByName(again)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest id."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.struct(*(quoted(c) for c in docs.columns)).alias("row"))
    flagged = _flagged(rows, "text", "repeated")
    once = flagged.filter("NOT repeated").select("row.*")
    # max_by combines on the map side, so a hot text sends one row a task.
    order = F.struct(F.col("id").isNotNull(), F.col("id"))
    won = flagged.filter("repeated").groupBy(_digest("text").alias("digest")).agg(F.max_by("row", order).alias("row")).select("row.*")
    return once.unionByName(won)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
