"""Tables by name, kept as Parquet under a folder of any scheme, with a JSON side file of schemas, kinds of storage and statistics.

A clustered table (``bplustree``) is range-partitioned and sorted by its key when written, so row-group bounds let range selections skip
most of it. Re-creating a table replaces it. Statistics are unknown until a load. A table written anew gets a new folder, to which the side file
then points, so a crash in between leaves the old table whole.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

from tarnlake.functions.expr import SPARK_TYPES, Kind
from tarnlake.plans.estimate import Statistics
from tarnlake.plans.parser import CreateTable
from tarnlake.sources import stats, textio
from tarnlake.sources.files import Files


class CatalogError(ValueError):
    """An unknown table or column."""


@dataclass
class TableInfo:
    name: str
    schema: dict[str, str]
    file_type: str = "heap"
    sort_attribute: str | None = None
    rows: float | None = None
    distinct: dict[str, float] = field(default_factory=dict)
    #: Which writing of the table holds.
    version: int = 0

    def kinds(self) -> dict[str, Kind]:
        return {c: Kind(k) for c, k in self.schema.items()}

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, SPARK_TYPES[k]) for c, k in self.kinds().items()])


class Catalog:
    """Persistent tables under a folder; ``put`` and ``get`` keep small values of any JSON type beside them."""

    FILE = "catalog.json"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.tables: dict[str, TableInfo] = {}
        self.values: dict[str, object] = {}
        if at := self.files.newest(f"{self.root}/{self.FILE}"):
            saved = json.loads(self.files.read(at))
            self.tables = {n: TableInfo(**t) for n, t in saved["tables"].items()}
            self.values = saved["values"]

    def save(self) -> None:
        self.files.write(f"{self.root}/{self.FILE}", json.dumps({"tables": {n: asdict(t) for n, t in self.tables.items()}, "values": self.values}, indent=1))

    def put(self, key: str, value: str | int | list[str]) -> None:
        self.values[key] = value

    def get(self, key: str):
        return self.values.get(key)

    def names(self) -> list[str]:
        return sorted(self.tables)

    def info(self, name: str) -> TableInfo:
        if name not in self.tables:
            raise CatalogError(f"table {name} is not found")
        return self.tables[name]

    def path(self, name: str) -> str:
        version = self.info(name).version
        return f"{self.root}/tables/{name}" + (f"-{version}" if version else "")

    def create(self, statement: CreateTable) -> TableInfo:
        columns = [c for c, _ in statement.attributes]
        if len(set(columns)) < len(columns):
            raise CatalogError(f"a column of {statement.name} stands twice")
        if statement.sort_attribute is not None and statement.sort_attribute not in columns:
            raise CatalogError(f"{statement.name} has no column {statement.sort_attribute}")
        info = TableInfo(statement.name, {c: k.value for c, k in statement.attributes}, "bplustree" if statement.sort_attribute else "heap", statement.sort_attribute)
        self.tables[statement.name] = info
        self.spark.createDataFrame([], info.struct()).write.mode("overwrite").parquet(self.path(statement.name))
        return info

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.info(name).struct()).parquet(self.path(name))

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        """Rows into a table, clustered where it is; ``append`` adds files that are each sorted."""
        info = self.info(name)
        rows = df.select(*(df[c].cast(SPARK_TYPES[k]).alias(c) for c, k in info.kinds().items()))
        if info.sort_attribute:
            rows = rows.repartitionByRange(info.sort_attribute).sortWithinPartitions(info.sort_attribute)
        rows.write.mode(mode).parquet(self.path(name))

    def clear(self, name: str) -> None:
        """Removes a table's rows, and what was known about them."""
        info = self.info(name)
        self.spark.createDataFrame([], info.struct()).write.mode("overwrite").parquet(self.path(name))
        info.rows, info.distinct = None, {}

    def append(self, name: str, df: DataFrame) -> None:
        self.write(name, df, "append")

    def recluster(self, name: str) -> None:
        """Writes a clustered table anew after appends; the old folder goes when the side file names the new one."""
        info, old, rows = self.info(name), self.path(name), self.table(name)
        info.version += 1
        try:
            self.write(name, rows)
        except BaseException:
            info.version -= 1
            raise
        self.save()
        self.files.delete(old)

    def load(self, name: str, path: str) -> Statistics:
        """Replaces a table's rows by those of text files, and measures it."""
        self.write(name, textio.read_text(self.spark, path, self.info(name).kinds()))
        return self.measure(name)

    def measure(self, name: str) -> Statistics:
        found, info = stats.measure(self.table(name)), self.info(name)
        info.rows, info.distinct = found.rows, dict(found.distinct)
        return found

    def statistics(self, name: str) -> Statistics | None:
        info = self.info(name)
        return None if info.rows is None else Statistics(info.rows, info.distinct)

    def dump(self, name: str, path: str) -> None:
        textio.write_text(self.table(name), path)
