"""Table statistics: rows, and approximate distinct values by column, in one pass that never gathers values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnlake.plans.estimate import Statistics

ERROR = 0.05


def distinct_counts(df: DataFrame) -> DataFrame:
    """One row: n_rows, then a sketch's estimate for each column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.approx_count_distinct(f"`{c}`", ERROR).alias(c) for c in df.columns))


def measure(df: DataFrame) -> Statistics:
    row = distinct_counts(df).first().asDict()
    return Statistics(float(row.pop("n_rows")), {c: float(v) for c, v in row.items()})
