"""Expression nodes and their lowering to Columns.

All semantics of the dialect that differ from Spark's live here and are decided by operand types: ``+`` with a text side concatenates (numbers
as text, doubles with six decimals), division of two integers truncates toward zero, comparison with a text side compares text, and the
average of integers truncates. Everything else is Spark's own operator, so Catalyst sees ordinary expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, functions as F, types as T


class Kind(Enum):
    """Types of the dialect; MOMENT is a date or timestamp column of a Parquet table, which behaves as its text."""

    INT = "int"
    DOUBLE = "double"
    STRING = "string"
    BOOL = "bool"
    MOMENT = "moment"

    @property
    def family(self) -> str:
        return {"int": "NUMBER", "double": "NUMBER", "bool": "BOOLEAN"}.get(self.value, "STRING")


SPARK_TYPES = {Kind.INT: T.IntegerType(), Kind.DOUBLE: T.DoubleType(), Kind.STRING: T.StringType(), Kind.BOOL: T.BooleanType()}


def kind_of(data_type: T.DataType) -> Kind:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind.INT
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Kind.DOUBLE
    if isinstance(data_type, T.BooleanType):
        return Kind.BOOL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Kind.MOMENT
    if isinstance(data_type, T.StringType):
        return Kind.STRING
    raise TypeError(f"columns of type {data_type.simpleString()} have no place in the dialect")


@dataclass(frozen=True)
class Node:
    """An expression; equal expressions are equal nodes."""

    def children(self) -> tuple[Node, ...]:
        return ()

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class Literal(Node):
    value: int | float | str | bool
    kind: Kind


@dataclass(frozen=True)
class Attr(Node):
    """A column, of a table alias or (in the operator API) of the input itself."""

    alias: str
    name: str

    @property
    def key(self) -> str:
        return f"{self.alias}.{self.name}" if self.alias else self.name


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node

    def children(self):
        return self.left, self.right


@dataclass(frozen=True)
class Unary(Node):
    op: str
    child: Node

    def children(self):
        return (self.child,)


@dataclass(frozen=True)
class Aggregate(Node):
    """``sum``, ``avg`` or ``count`` of an expression."""

    fn: str
    child: Node

    def children(self):
        return (self.child,)


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: Kind
    literal: object = None


Resolve = Callable[[Node], "Typed | None"]


def as_text(x: Typed) -> Column:
    """The text that concatenation and comparison see."""
    if x.kind is Kind.DOUBLE:
        return F.format_string("%.6f", x.column.cast("double"))
    if x.kind is Kind.MOMENT:
        return F.date_format(x.column, "yyyy-MM-dd")
    return x.column.cast("string")


def _is_text(*sides: Typed) -> bool:
    return any(s.kind in (Kind.STRING, Kind.MOMENT) for s in sides)


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if op == "+" and (_is_text(a, b) or Kind.BOOL in (a.kind, b.kind)):
        return Typed(F.concat(as_text(a), as_text(b)), Kind.STRING)
    if a.kind.family != "NUMBER" or b.kind.family != "NUMBER":
        raise TypeError(f"{op} takes numbers")
    if op == "/":
        if a.kind is b.kind is Kind.INT:
            return Typed(F.call_function("div", a.column, b.column), Kind.INT)
        return Typed(a.column.cast("double") / b.column.cast("double"), Kind.DOUBLE)
    kind = Kind.INT if a.kind is b.kind is Kind.INT else Kind.DOUBLE
    return Typed({"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column}[op], kind)


def _comparison(op: str, a: Typed, b: Typed) -> Typed:
    if a.kind is Kind.MOMENT and b.kind is not Kind.MOMENT or b.kind is Kind.MOMENT and a.kind is not Kind.MOMENT:
        moment, other = (a, b) if a.kind is Kind.MOMENT else (b, a)
        #: A whole date as a literal is compared as a moment, so that the scan can prune by it.
        if isinstance(other.literal, str) and len(other.literal) == 10 and other.literal.replace("-", "").isdigit():
            other = Typed(F.lit(other.literal).cast("timestamp_ntz"), Kind.MOMENT)
        else:
            moment, other = Typed(as_text(moment), Kind.STRING), Typed(as_text(other), Kind.STRING)
        a, b = (moment, other) if a.kind is Kind.MOMENT else (other, moment)
    elif a.kind is not b.kind and (_is_text(a, b) or Kind.BOOL in (a.kind, b.kind)):
        a, b = Typed(as_text(a), Kind.STRING), Typed(as_text(b), Kind.STRING)
    x, y = a.column, b.column
    return Typed({">": x > y, "<": x < y, "==": x == y, "!=": x != y}[op], Kind.BOOL)


def lower(node: Node, resolve: Resolve) -> Typed:
    """The Column and type of an expression; ``resolve`` gives columns, and may give whole expressions that are known already."""
    known = resolve(node)
    if known is not None:
        return known
    if isinstance(node, Literal):
        return Typed(F.lit(node.value).cast(SPARK_TYPES[node.kind]), node.kind, node.value)
    if isinstance(node, Attr):
        raise KeyError(f"unknown column {node.key}")
    if isinstance(node, Binary):
        if node.op in ("&&", "||"):
            a, b = lower(node.left, resolve).column, lower(node.right, resolve).column
            return Typed(a & b if node.op == "&&" else a | b, Kind.BOOL)
        a, b = lower(node.left, resolve), lower(node.right, resolve)
        return (_arithmetic if node.op in "+-*/" else _comparison)(node.op, a, b)
    if isinstance(node, Unary):
        x = lower(node.child, resolve)
        return Typed(~x.column, Kind.BOOL) if node.op == "!" else Typed(-x.column, x.kind)
    if isinstance(node, Aggregate):
        return aggregate(node.fn, lower(node.child, resolve))
    raise TypeError(f"no lowering for {node!r}")


def aggregate(fn: str, x: Typed) -> Typed:
    """Sums of integers are 64 bits wide; the average of integers truncates; count ignores its argument."""
    if fn == "count":
        return Typed(F.count(F.lit(1)), Kind.INT)
    if x.kind.family != "NUMBER":
        raise TypeError(f"{fn} takes numbers")
    if fn == "sum":
        return Typed(F.sum(x.column), x.kind)
    if fn == "avg":
        return Typed(F.call_function("div", F.sum(x.column), F.count(F.lit(1))), Kind.INT) if x.kind is Kind.INT else Typed(F.avg(x.column), Kind.DOUBLE)
    raise ValueError(f"unknown aggregate {fn}")


def columns_of(df: DataFrame) -> Resolve:
    """Resolves attributes, with or without an alias, to the columns of a DataFrame that are named by their key."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def resolve(node: Node) -> Typed | None:
        if isinstance(node, Attr) and node.key in kinds:
            return Typed(F.col(f"`{node.key}`"), kind_of(kinds[node.key]))
        return None

    return resolve
