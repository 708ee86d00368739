"""Selection, range selection, joins, aggregation and sort.

Every operator only builds a plan. Expressions may be prefix strings, nodes or Columns. Join sides are broadcast behind a size check alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tarnlake.functions import expr, prefix

Expression = str | expr.Node | Column
#: A side is broadcast when Spark's own estimate of its size is at most this.
BROADCAST_BYTES = 64 << 20
STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "auto": None, "broadcast": "broadcast"}


def column(df: DataFrame, e: Expression) -> Column:
    """An expression over a DataFrame's columns."""
    if isinstance(e, Column):
        return e
    return expr.lower(prefix.parse(e) if isinstance(e, str) else e, expr.columns_of(df)).column


def _conjunction(df: DataFrame, predicates: Expression | Sequence[Expression] | None) -> Column:
    if predicates is None:
        return F.lit(True)
    if isinstance(predicates, (str, Column, expr.Node)):
        predicates = [predicates]
    return reduce(Column.__and__, (column(df, p) for p in predicates), F.lit(True))


def _project(df: DataFrame, projections: Mapping[str, Expression] | None) -> DataFrame:
    return df if projections is None else df.select(*(column(df, e).alias(name) for name, e in projections.items()))


def selection(df: DataFrame, predicate: Expression | Sequence[Expression] | None = None, projections: Mapping[str, Expression] | None = None) -> DataFrame:
    """Rows that satisfy the predicate, computed columns."""
    return _project(df.filter(_conjunction(df, predicate)), projections)


def range_selection(df: DataFrame, key: str, low, high, predicate: Expression | Sequence[Expression] | None = None, projections: Mapping[str, Expression] | None = None, ordered: bool = False) -> DataFrame:
    """Rows whose key lies in [low, high], both ends included; on clustered tables the scan skips row groups by their bounds."""
    inside = df.filter(F.col(key).between(low, high))
    return _project((inside.orderBy(key) if ordered else inside).filter(_conjunction(df, predicate)), projections)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def estimated_rows(df: DataFrame) -> float:
    """Rows by that estimate, at eight bytes a number and twenty a text."""
    width = sum(20 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 8 for f in df.schema.fields)
    return max(1.0, estimated_bytes(df) / max(1, width))


def join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[tuple[Expression, Expression]],
    predicate: Expression | Sequence[Expression] | None = None,
    projections: Mapping[str, Expression] | None = None,
    left_predicate: Expression | Sequence[Expression] | None = None,
    right_predicate: Expression | Sequence[Expression] | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Inner equi-join on computed keys, sides filtered first, the whole predicate held against the pairs.

    Column names of the two sides must differ. "auto" leaves the choice to Catalyst and adaptive execution; "broadcast" falls back to a
    shuffled hash join where neither side is small enough.
    """
    if not keys:
        raise ValueError("an equi-join needs keys; use cross_join or theta_join")
    left, right = left.filter(_conjunction(left, left_predicate)), right.filter(_conjunction(right, right_predicate))
    on = reduce(Column.__and__, (column(left, a) == column(right, b) for a, b in keys))
    hint = STRATEGIES[strategy]
    if hint == "broadcast":
        sizes = estimated_bytes(left), estimated_bytes(right)
        if min(sizes) > BROADCAST_BYTES:
            hint = "shuffle_hash"
        elif sizes[0] < sizes[1]:
            left, hint = left.hint(hint), None
    joined = left.join(right.hint(hint) if hint else right, on, "inner")
    return _project(joined.filter(_conjunction(joined, predicate)), projections)


def cross_join(left: DataFrame, right: DataFrame, projections: Mapping[str, Expression] | None = None) -> DataFrame:
    """Every pair of rows; both sides should be filtered."""
    return _project(left.crossJoin(right), projections)


def theta_join(left: DataFrame, right: DataFrame, predicate: Expression, projections: Mapping[str, Expression] | None = None) -> DataFrame:
    """Pairs that satisfy any predicate over both sides; a side of a checked size is broadcast, else pairs are made in blocks."""
    sizes = estimated_bytes(left), estimated_bytes(right)
    if min(sizes) <= BROADCAST_BYTES:
        left, right = (left.hint("broadcast"), right) if sizes[0] < sizes[1] else (left, right.hint("broadcast"))
    pairs = left.crossJoin(right)
    return _project(pairs.filter(column(pairs, predicate)), projections)


def aggregate(df: DataFrame, aggregates: Mapping[str, tuple[str, Expression]], groupings: Mapping[str, Expression] | None = None, predicate: Expression | Sequence[Expression] | None = None) -> DataFrame:
    """Groups by computed keys; columns are the groupings, then the aggregates, each (``sum``, ``avg`` or ``count``, expression).

    Without groupings an empty input gives no row.
    """
    kept = df.filter(_conjunction(df, predicate))
    resolve = expr.columns_of(kept)

    def aggregated(fn: str, e: Expression) -> Column:
        if isinstance(e, Column):
            typed = expr.Typed(e, expr.kind_of(kept.select(e).schema[0].dataType))
        else:
            typed = expr.lower(prefix.parse(e) if isinstance(e, str) else e, resolve)
        return expr.aggregate(fn, typed).column

    found = [aggregated(fn, e).alias(name) for name, (fn, e) in aggregates.items()]
    if groupings:
        return kept.groupBy(*(column(kept, e).alias(name) for name, e in groupings.items())).agg(*found)
    return kept.agg(*found, F.count(F.lit(1)).alias("_rows")).filter("_rows > 0").drop("_rows")


def sort(df: DataFrame, key: Expression, predicate: Expression | Sequence[Expression] | None = None) -> DataFrame:
    """Rows in ascending order of a computed key."""
    return df.filter(_conjunction(df, predicate)).orderBy(column(df, key))


def sort_partitions(df: DataFrame, key: Expression) -> DataFrame:
    """Each partition in ascending order of a computed key."""
    return df.sortWithinPartitions(column(df, key))
