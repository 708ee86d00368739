"""The interactive verbs: statements ended by a semicolon, ``load``, ``init`` and ``exit``, and the display of the first rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tarnlake.functions.expr import Kind, kind_of
from tarnlake.operators.relops import estimated_rows
from tarnlake.plans import estimate, lowering
from tarnlake.plans.checker import VALID, Checker
from tarnlake.plans.parser import CreateTable, Select, parse
from tarnlake.sources.catalog import Catalog
from tarnlake.sources.textio import lines

DISPLAY_ROWS = 30
#: The tables that ``init`` loads.
BENCHMARK_TABLES = ("part", "supplier", "partsupp", "customer", "orders", "lineitem", "nation", "region")


def statements(text_lines: Iterable[str]) -> Iterable[str]:
    """Statements up to the first semicolon; the rest of that line is dropped."""
    held: list[str] = []
    for line in text_lines:
        before, end, _ = line.partition(";")
        held.append(before)
        if end:
            yield "\n".join(held).strip()
            held = []


class Engine:
    """Runs the dialect over a catalog's tables, over registered DataFrames, or both."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, frames: Mapping[str, DataFrame] | None = None):
        self.spark, self.catalog, self.frames = spark, catalog, dict(frames or {})

    @classmethod
    def over_parquet(cls, spark: SparkSession, folder: str, names: Iterable[str]) -> Engine:
        """An engine over Parquet files, each a table of its name."""
        return cls(spark, frames={n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    def register(self, name: str, df: DataFrame) -> None:
        self.frames[name] = df

    def _known(self) -> set[str]:
        return set(self.frames) | set(self.catalog.tables if self.catalog else ())

    def table(self, name: str) -> DataFrame:
        return self.frames[name] if name in self.frames else self.catalog.table(name)

    def schema(self, name: str) -> dict[str, Kind]:
        """Columns with a type of the dialect; others can't be named."""
        found = {}
        for f in self.table(name).schema.fields:
            try:
                found[f.name] = kind_of(f.dataType)
            except TypeError:
                continue
        return found

    def _schemas(self, query: Select) -> dict[str, dict[str, Kind]]:
        return {n: self.schema(n) for n, _ in query.tables if n in self._known()}

    def check(self, text: str) -> str:
        """VALID QUERY, or the first error."""
        query = parse(text)
        return Checker(self._schemas(query)).check(query) if isinstance(query, Select) else VALID

    def _statistics(self, query: Select) -> dict[str, estimate.Statistics]:
        """What is known by alias: measured statistics, or rows estimated from the bytes of the files. No job is run for it."""
        found = {n: (self.catalog.statistics(n) if self.catalog and n in self.catalog.tables and n not in self.frames else None) or estimate.Statistics(estimated_rows(self.table(n))) for n in {n for n, _ in query.tables}}
        return {alias: found[n] for n, alias in query.tables}

    def cost(self, text: str) -> float:
        """The estimated cost of the plan that is run."""
        query = parse(text)
        return estimate.plan_cost(query, self._statistics(query))

    def sql(self, text: str) -> DataFrame:
        """The result of a query."""
        query = parse(text)
        if not isinstance(query, Select):
            raise ValueError("sql() takes a query; use execute()")
        Checker(self._schemas(query)).require(query)
        return lowering.run(query, {n: self.table(n) for n, _ in query.tables}, self._statistics(query) if len(query.tables) > 2 else None)

    def load(self, name: str, path: str) -> estimate.Statistics:
        return self.catalog.load(name, path)

    def init(self, folder: str = "./tables") -> None:
        """Loads the benchmark tables that the catalog has from their text files."""
        for name in BENCHMARK_TABLES:
            if name in self.catalog.tables:
                self.load(name, f"{folder}/{name}.tbl")

    def close(self) -> None:
        if self.catalog:
            self.catalog.save()

    def execute(self, statement: str, out: Callable[[str], None] = print) -> bool:
        """One statement, its outcome told to ``out``; False when the session ends."""
        text = statement.strip().rstrip(";").strip()
        if text.lower() in ("exit", "quit"):
            self.close()
            return False
        if text.lower() == "init":
            self.init()
            out("OK, loaded the benchmark tables.")
        elif m := re.fullmatch(r"load\s+(\S+)\s+from\s+(\S+)", text, re.I):
            found = self.load(m[1], m[2])
            out(f"OK, loaded {int(found.rows)} rows into {m[1]}.")
        else:
            parsed = parse(text)
            if isinstance(parsed, CreateTable):
                self.catalog.create(parsed)
                out(f"OK, created table {parsed.name}.")
            else:
                for row in self.display(self.sql(text)):
                    out(row)
        return True

    @staticmethod
    def display(df: DataFrame, rows: int = DISPLAY_ROWS) -> list[str]:
        """The first rows as text."""
        return [r.value for r in lines(df.limit(rows)).collect()]

    def run(self, text_lines: Iterable[str], out: Callable[[str], None] = print) -> None:
        """All statements of a script; a failing one is told and passed over."""
        for statement in statements(text_lines):
            try:
                if not self.execute(statement, out):
                    return
            except ValueError as e:
                out(str(e))
        self.close()
