"""Scans by stretch: rows of ranges of files, and rows one at a time. Files stand in for the pages of a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, functions as F


def files_of(df: DataFrame) -> list[str]:
    """The files that a DataFrame over a Parquet table reads, in the order of their names, which is the order of writing in one append."""
    return sorted(df.inputFiles())


def stretches(df: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows of files low to high, both included and counted from 0, of each of several ranges; files in two ranges are read once for each.

    Only these files are read. ``df`` is a Parquet table, with columns as they are in the files or fewer.
    """
    files = files_of(df)
    chosen = [f for low, high in ranges for f in files[max(0, low) : high + 1]]
    empty = df.filter(F.lit(False))
    if not chosen:
        return empty
    read = lambda paths: df.sparkSession.read.schema(df.schema).parquet(*paths)
    out, seen = None, {f: chosen.count(f) for f in chosen}
    for times in range(1, max(seen.values()) + 1):
        part = read([f for f in dict.fromkeys(chosen) if seen[f] >= times])
        out = part if out is None else out.unionByName(part)
    return out


def partition_range(df: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of partitions low to high, both included, of any DataFrame; tables of files have :func:`stretches`, which reads less."""
    return df.filter(F.spark_partition_id().between(low, high))


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows one at a time, a partition of them in memory at once."""
    return df.toLocalIterator()
