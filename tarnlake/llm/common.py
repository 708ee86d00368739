"""What the corpus operators share: paths of tables, scratch tables that survive lost executors, native span search."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Items in a block of a scan, and code points in a chunk of a text.
BLOCK, CHUNK = 64, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a cluster
    no machine's own folder would do, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), f"tarnlake-{uuid.uuid4().hex}")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, and survives lost executors. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is worked out once; an expression used inside a lambda is otherwise worked out at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stretch(items: Column, first: Column, last: Column) -> Column:
    """Items first to last, both included and counted from 0; ``slice`` copies the whole array each time."""
    return F.transform(F.sequence(first, last), lambda k: F.get(items, k))


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What a scan over an array gives for each item, as array<kind>: ``step`` takes state and item, and gives the next state and the output.

    Appending to an array copies it, so outputs are gathered in blocks of BLOCK and the blocks then joined: time is in proportion to the
    items as long as these are fewer than some millions.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["got"], F.array(out.cast(kind))).alias("got"))

    def block(acc: Column, part: Column) -> Column:
        #: ``let`` would copy all that is gathered, so a block's outputs are taken up by the next step.
        done = F.aggregate(part, F.struct(acc["done"]["state"].alias("state"), none.alias("got")), one)
        return F.struct(done.alias("done"), taken(acc).alias("got"))

    def taken(acc: Column) -> Column:
        return F.concat(acc["got"], F.array(acc["done"]["got"]))

    def whole(all_items: Column) -> Column:
        last = F.size(all_items) - 1
        starts = F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int"))
        parts = F.transform(starts, lambda i: stretch(all_items, i * BLOCK, F.least(i * BLOCK + BLOCK - 1, last)))
        begin = F.struct(F.struct(start.alias("state"), none.alias("got")).alias("done"), nones.alias("got"))
        return F.when(last < 0, none).otherwise(F.aggregate(parts, begin, block, lambda acc: F.flatten(taken(acc))))

    return let(items, whole)


def match_spans(text: Column, pattern: str, guard: Column, context: int = 0) -> Column:
    """All leftmost non-overlapping matches of a Java pattern as array<struct<s:int,e:int,m:string>>, in code points, end exclusive.

    Splitting by the pattern gives the text between the matches that extraction gives, so running lengths are the offsets. With ``context``
    each match also has ``before``, that many code points of the text before it, and ``after``, as many up to the next match at most.
    The pattern must not match the empty string; the guard is a cheap necessary condition that spares most texts both passes. Time is in
    proportion to the text.
    """
    kind = "struct<s:int,e:int,m:string>" if not context else "struct<s:int,e:int,m:string,before:string,after:string>"
    size = lambda c: F.coalesce(F.char_length(c), F.lit(0))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        begin = state["at"] + size(x["p"])
        end = begin + size(x["m"])
        if not context:
            return F.struct(end.alias("at")), F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("m"))
        before = F.right(F.concat(state["tail"], F.right(x["p"], F.lit(context))), F.lit(context))
        tail = F.right(F.concat(before, F.right(F.coalesce(x["m"], F.lit("")), F.lit(context))), F.lit(context))
        after = F.left(F.coalesce(x["q"], F.lit("")), F.lit(context))
        return F.struct(end.alias("at"), tail.alias("tail")), F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("m"), before.alias("before"), after.alias("after"))

    def walked(pieces: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")
        zipped = F.arrays_zip(pieces.alias("p"), found, *([F.slice(pieces, 2, F.size(pieces)).alias("q")] if context else []))
        start = F.struct(F.lit(0).alias("at"), *([F.lit("").alias("tail")] if context else []))
        return F.filter(running(zipped, start, step, kind), lambda x: x["m"].isNotNull())

    return F.when(guard, let(F.split(text, pattern, -1), walked)).otherwise(F.array().cast(f"array<{kind}>"))


def pieces_around(text: Column, spans: Column) -> Column:
    """The text around disjoint spans in order (structs with s and e): what stands before each, and after the last.

    A substring is found by counting from its text's start, so the text is cut into chunks first: time is in proportion to the text.
    """

    def cut(chunks: Column, own: Column) -> Column:
        def between(begin: Column, end: Column) -> Column:
            first = F.floor(begin / CHUNK).cast("int")
            near = F.array_join(stretch(chunks, first, F.floor(end / CHUNK).cast("int")), "")
            return F.substring(near, begin - first * CHUNK + 1, end - begin)

        before = F.transform(own, lambda x, i: between(F.when(i > 0, F.get(own, i - 1)["e"]).otherwise(F.lit(0)), x["s"]))
        last = F.coalesce(F.get(own, F.size(own) - 1)["e"], F.lit(0))
        return F.concat(before, F.array(between(last, F.size(chunks) * CHUNK)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(chunks, lambda c: let(spans, lambda own: cut(c, own)))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """Spans with their kind and its place in the order of kinds."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end of tagged spans by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digits_of(text: Column) -> Column:
    """The ASCII digits of a string."""
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i"))),
        F.lit(0),
        lambda acc, x: acc
        + F.coalesce(
            F.when(x["i"] % 2 == 0, x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2),
            F.lit(0),
        ),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(code: Column) -> Column:
    """The remainder by 97 of an IBAN without blanks, its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
