"""References to records that do not exist.

A reference is orphaned when its target is missing, deleted, or arrived after the referring row. The skew-aware split:
references are pre-aggregated per key and period, and these cells are compared with the targets, which settles nearly all of
them. Rows are only looked at where they are asked for, or where a cell holds both orphans and others. There the heaviest
cells are broadcast, a fixed number of them, so that any other cell holds a bounded part of all references; those go through
a shuffle join after an anti-join with the heavy ones, and both sides are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrove.functions.ids import reference_key
from paragrove.runtime import HEAVY_CELLS, Shelf, split_join

KEY = ["manual", "ref_kind", "ref_id"]
CELL = [*KEY, "month"]


def references(chunks: DataFrame) -> DataFrame:
    """One row per chunk and distinct reference: chunk_id, manual, ref_kind, ref_id, ref_at (the chunk's earliest ingestion).

    Null or blank array entries are no references; a null or empty array gives no row; rows of the same chunk_id merge.
    """
    def side(column: str, kind: str) -> DataFrame:
        return chunks.select("chunk_id", "manual", "ingested_at", F.explode(column).alias("raw")).select(
            "chunk_id", "manual", "ingested_at", F.lit(kind).alias("ref_kind"), reference_key(F.col("raw")).alias("ref_id"))

    both = side("figure_refs", "Figure").unionByName(side("table_refs", "Table"))
    return both.where("ref_id IS NOT NULL AND ref_id <> ''").groupBy("chunk_id", *KEY).agg(F.min("ingested_at").alias("ref_at"))


def targets(figures: DataFrame) -> DataFrame:
    """One row per manual, kind and id: when its first row arrived, and how many rows are not deleted."""
    return figures.groupBy("manual", F.col("kind").alias("ref_kind"), reference_key(F.col("canonical_id")).alias("ref_id")).agg(
        F.min("ingested_at").alias("first_seen"), F.sum(F.col("deleted_at").isNull().cast("bigint")).alias("live"))


def _month(c: str):
    return F.date_format(c, "yyyy-MM")


def orphan_cells(refs: DataFrame, figures: DataFrame) -> DataFrame:
    """The cells (key and month) with at least one orphan: n_refs, first_seen, live, reason; reason is null where only some are late.

    One row per cell whatever the number of references; a null manual and a null month are values of their own.
    """
    cells = refs.groupBy(*KEY, _month("ref_at").alias("month")).agg(F.count("*").alias("n_refs"), F.min("ref_at").alias("first_ref"), F.max("ref_at").alias("last_ref"))
    met = cells.join(targets(figures).hint("merge"), KEY, "left").where("live IS NULL OR live = 0 OR first_seen > first_ref")
    reason = F.when(F.col("live").isNull(), "missing").when(F.col("live") == 0, "deleted").when(F.col("first_seen") > F.col("last_ref"), "late")
    return met.select(*CELL, "n_refs", "first_seen", reason.alias("reason"))


def _rows(refs: DataFrame, cells: DataFrame, shelf: Shelf, most: int) -> DataFrame:
    """The references of the cells with their reason; those of a mixed cell that are late."""
    hit = split_join(refs.withColumn("month", _month("ref_at")), cells, CELL, "n_refs", shelf, "heavy", most)
    return hit.withColumn("reason", F.coalesce("reason", F.when(F.col("first_seen") > F.col("ref_at"), "late"))).where("reason IS NOT NULL")


def orphan_references(chunks: DataFrame, figures: DataFrame, heavy_cells: int = HEAVY_CELLS) -> DataFrame:
    """chunk_id, ref_kind, ref_id, reason, ref_at for every orphaned reference.

    reason is 'missing' (no row of that manual, kind and id), 'deleted' (rows exist, all deleted) or 'late' (the first
    row came after the chunk). A chunk without manual finds no target, so its references are missing. Repeated figure
    rows change nothing. Empty tables give an empty result, empty figures make every reference missing.
    heavy_cells: how many cells are broadcast; any other cell has less than one part in so many of all references.
    """
    shelf = Shelf(chunks.sparkSession)
    refs = shelf.keep(references(chunks), "refs")
    cells = shelf.keep(orphan_cells(refs, figures), "cells")
    return _rows(refs, cells, shelf, heavy_cells).select("chunk_id", "ref_kind", "ref_id", "reason", "ref_at")


def orphan_report(chunks: DataFrame, figures: DataFrame, heavy_cells: int = HEAVY_CELLS) -> DataFrame:
    """Orphan counts per referring field, month of ingestion and reason, with the share of all references of that field and month.

    Cells of one reason are counted as they are; only the references of mixed cells are counted one by one.
    """
    shelf = Shelf(chunks.sparkSession)
    found = shelf.keep(references(chunks), "refs")
    cells = shelf.keep(orphan_cells(found, figures), "cells")
    mixed = cells.where("reason IS NULL")
    one = _rows(found, mixed, shelf, heavy_cells).groupBy("ref_kind", "month", "reason").agg(F.count("*").alias("n"))
    sure = cells.where("reason IS NOT NULL").groupBy("ref_kind", "month", "reason").agg(F.sum("n_refs").alias("n"))
    bad = sure.unionByName(one).groupBy("ref_kind", "month", "reason").agg(F.sum("n").alias("n_orphans"))
    refs = found.groupBy("ref_kind", _month("ref_at").alias("month")).agg(F.count("*").alias("n_refs"))
    on = [bad.ref_kind == refs.ref_kind, bad.month.eqNullSafe(refs.month)]
    return bad.join(refs, on).select(
        F.when(bad.ref_kind == "Figure", "figure_refs").otherwise("table_refs").alias("field"), bad.month, "reason", "n_orphans", "n_refs",
        F.round(F.col("n_orphans") / F.col("n_refs"), 6).alias("orphan_share"))
