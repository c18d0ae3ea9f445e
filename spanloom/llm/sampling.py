"""Bounded samples of whole rows for fitting a small model in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import row_hash


def bounded(rows: DataFrame, group: str, per_group: int, max_bytes: int) -> DataFrame:
    """Of rows(text, group, ...), up to `per_group` rows of each value of the group column, those of least hash of
    text and row, while their whole texts have `max_bytes` bytes at most; at least one row of each. Ties go to any of
    the equal rows."""
    rows = rows.withColumn("_rank", row_hash("text", seed=17))
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    cut = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, 1.3 * per_group / n + 60 / n)
        own = F.col(group).eqNullSafe(F.lit(value))
        cut |= own & (F.col("_rank") < int(-(2**63) + share * 2**64)) if share < 1 else own
    w = Window.partitionBy(group).orderBy("_rank")
    rows = rows.where(cut).withColumns({"_n": F.row_number().over(w), "_bytes": F.sum(F.octet_length("text").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.where((F.col("_n") <= per_group) & ((F.col("_bytes") <= max_bytes) | (F.col("_n") == 1))).drop("_n", "_bytes")
