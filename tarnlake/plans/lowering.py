"""From a parsed query to a DataFrame.

Tables are projected under ``alias.column`` names; one-alias conjuncts filter their scan; tables are joined along the tree that the estimates
favour, of any shape, and cross-joined only where nothing connects them. Without a tree they are joined in the order of FROM as far as they
connect. Tables that a grouped query neither names nor connects are only counted: their number of rows multiplies the sums. Catalyst prunes
columns, pushes predicates into scans and picks the physical joins.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tarnlake.functions.expr import Aggregate, Attr, Node, Typed, columns_of, lower
from tarnlake.plans.checker import CheckError
from tarnlake.plans.estimate import Planner, Statistics, is_key
from tarnlake.plans.parser import Select


def _aliases(node: Node) -> frozenset[str]:
    return frozenset(n.alias for n in node.walk() if isinstance(n, Attr))


def _scan(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(f"{alias}.{c}") for c in df.columns))


def _filtered(df: DataFrame, conjuncts: list[Node]) -> DataFrame:
    if not conjuncts:
        return df
    resolve = columns_of(df)
    return df.filter(reduce(Column.__and__, (lower(c, resolve).column for c in conjuncts)))


def _in_order(query: Select) -> object:
    """A tree in the order of FROM, tables that connect to what is joined already first."""
    left = [alias for _, alias in query.tables]
    tree, done = left[0], {left.pop(0)}
    while left:
        alias = next((a for a in left if any(is_key(c, frozenset(done), frozenset([a])) for c in query.where)), left[0])
        left.remove(alias)
        tree, done = (tree, alias), done | {alias}
    return tree


def join_tables(query: Select, tables: Mapping[str, DataFrame], tree: object = None) -> DataFrame:
    """The joined and filtered rows of a query's FROM and WHERE, along a tree of its aliases."""
    scans = {alias: _scan(tables[name], alias) for name, alias in query.tables}
    waiting, constant = [], []
    for c in dict.fromkeys(query.where):
        used = _aliases(c)
        if len(used) == 1:
            (alias,) = used
            scans[alias] = _filtered(scans[alias], [c])
        else:
            (waiting if used else constant).append(c)

    def joined(part: object) -> tuple[DataFrame, frozenset[str]]:
        if isinstance(part, str):
            return scans[part], frozenset([part])
        (left, a), (right, b) = joined(part[0]), joined(part[1])
        now = [c for c in waiting if _aliases(c) <= a | b and not _aliases(c) <= a and not _aliases(c) <= b]
        if not now:
            return left.crossJoin(right), a | b
        #: Types are resolved over both sides; the condition is then the join's own.
        resolvers = [columns_of(left), columns_of(right)]
        resolve = lambda node: next((t for r in resolvers if (t := r(node)) is not None), None)
        return left.join(right, reduce(Column.__and__, (lower(c, resolve).column for c in now)), "inner"), a | b

    return _filtered(joined(tree or _in_order(query))[0], constant)


def _only(query: Select, aliases: set[str]) -> Select:
    """The query over some of its tables; conditions without a table stay with it."""
    return replace(query, tables=tuple(t for t in query.tables if t[1] in aliases), where=tuple(c for c in query.where if _aliases(c) <= aliases))


def _counted(query: Select) -> list[set[str]]:
    """Parts of FROM that nothing connects to the rest and that neither the values nor the grouping name; never all of them."""
    parts = [{alias} for _, alias in query.tables]
    for c in query.where:
        used = _aliases(c)
        touched = [p for p in parts if p & used]
        if len(touched) > 1:
            parts = [p for p in parts if not p & used] + [set().union(*touched)]
    named = frozenset().union(*(_aliases(n) for n in (*query.values, *query.grouping)))
    free = [p for p in parts if not p & named]
    return free[1:] if len(free) == len(parts) else free


def run(query: Select, tables: Mapping[str, DataFrame], stats: Mapping[str, Statistics] | None = None) -> DataFrame:
    """The query's rows in columns output_0, output_1 and so on; ``stats`` by alias, where known, choose the join tree."""
    if len({alias for _, alias in query.tables}) < len(query.tables):
        raise CheckError("FROM: an alias stands twice")

    def rows_of(part: Select) -> DataFrame:
        tree = Planner(part, {a: stats[a] for _, a in part.tables}).best().tree if stats else None
        return join_tables(part, tables, tree)

    found = list(dict.fromkeys(n for v in query.values for n in v.walk() if isinstance(n, Aggregate)))
    if not found and not query.grouping:
        rows = rows_of(query)
        return rows.select(*(lower(v, columns_of(rows)).column.alias(f"output_{i}") for i, v in enumerate(query.values)))
    counted = _counted(query)
    rows = rows_of(_only(query, {a for _, a in query.tables} - set().union(*counted)))
    resolve = columns_of(rows)
    keys = [(g, f"group_{i}", lower(g, resolve)) for i, g in enumerate(dict.fromkeys(query.grouping))]
    sums = [(a, f"agg_{i}", lower(a, resolve)) for i, a in enumerate(found)]
    columns = [t.column.alias(n) for _, n, t in sums]
    if keys:
        by = [t.column.alias(n) for _, n, t in keys]
        grouped = rows.groupBy(*by).agg(*columns) if columns else rows.select(*by).distinct()
    else:
        grouped = rows.agg(*columns, F.count(F.lit(1)).alias("rows")).filter("rows > 0")
    times = F.lit(1)
    for i, part in enumerate(counted):
        free = rows_of(replace(_only(query, part), where=tuple(c for c in query.where if _aliases(c) and _aliases(c) <= part)))
        grouped = grouped.crossJoin(F.broadcast(free.agg(F.count(F.lit(1)).alias(f"times_{i}")).filter(f"times_{i} > 0")))
        times = times * F.col(f"times_{i}")
    scaled = lambda a, column: column * times if counted and a.fn == "sum" else column
    known = {node: Typed(F.col(name), typed.kind) for node, name, typed in keys} | {node: Typed(scaled(node, F.col(name)), typed.kind) for node, name, typed in sums}
    return grouped.select(*(lower(v, known.get).column.alias(f"output_{i}") for i, v in enumerate(query.values)))
