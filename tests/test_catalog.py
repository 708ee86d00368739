"""Catalog, text load and dump, clustered tables, statistics, the session's verbs, continuous loading."""

import pytest
from pyspark.sql import functions as F

from tarnlake import streaming
from tarnlake.functions.expr import Kind
from tarnlake.operators import relops as R
from tarnlake.plans.parser import parse
from tarnlake.plans.session import Engine
from tarnlake.sources import scan, textio
from tarnlake.sources.catalog import Catalog, CatalogError

PAIRS = [(3, 4.04), (1, 1.01), (2, 9.09), (4, 2.02), (5, 13.13), (6, 7.07), (7, 3.03), (8, 11.11), (10, 6.06), (9, 8.08), (11, 12.12), (12, 5.05), (13, 10.10)]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Catalog(spark, str(tmp_path / "db")))


def text_file(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines))
    return str(path)


def test_load_dump_and_reload(engine, tmp_path):
    said = []
    source = text_file(tmp_path, "pairs.tbl", [f"{i}|{v}|" for i, v in PAIRS])
    engine.execute("create table pairs (index INT, value DOUBLE)", said.append)
    engine.execute(f"load pairs from {source}", said.append)
    assert said[-1] == "OK, loaded 13 rows into pairs."
    info = engine.catalog.info("pairs")
    assert info.rows == 13 and info.distinct["index"] == 13
    assert sorted(map(tuple, engine.table("pairs").collect())) == sorted(PAIRS)
    engine.catalog.dump("pairs", str(tmp_path / "dump"))
    again = textio.read_text(engine.spark, str(tmp_path / "dump"), {"index": Kind.INT, "value": Kind.DOUBLE})
    assert sorted(map(tuple, again.collect())) == sorted(PAIRS)
    assert sorted(r.value for r in engine.spark.read.text(str(tmp_path / "dump")).collect())[0] == "10|6.060000|"


def test_text_cells(engine, tmp_path):
    source = text_file(tmp_path, "t.tbl", ['1||"quoted|true|', "2| a b |x|false|"])
    got = textio.read_text(engine.spark, source, {"i": Kind.INT, "a": Kind.STRING, "b": Kind.STRING, "c": Kind.BOOL}).collect()
    assert [tuple(r) for r in got] == [(1, "", '"quoted', True), (2, " a b ", "x", False)]
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        textio.read_text(engine.spark, text_file(tmp_path, "bad.tbl", ["x|"]), {"i": Kind.INT}).collect()


def test_sorting(spark):
    df = spark.createDataFrame(PAIRS, "index int, value double")
    assert [r[0] for r in R.sort(df, "[index]").collect()] == list(range(1, 14))
    assert [r.value for r in R.sort(df, "[value]").collect()] == sorted(v for _, v in PAIRS)
    assert [r[0] for r in R.sort(df, "um ([index])", "> ([index], int[10])").collect()] == [13, 12, 11]
    assert R.sort(df.limit(0), "[index]").collect() == []


def test_clustered_table(engine):
    engine.execute("create table c (k INT, v STRING) as bplustree on k", lambda _: None)
    rows = engine.spark.range(0, 3200).select((F.col("id") % 100).cast("int").alias("k"), F.col("id").cast("string").alias("v"))
    engine.catalog.write("c", rows)
    engine.catalog.append("c", rows.limit(0))
    for low, high in ((0, 99), (7, 7), (40, 42), (99, 120), (-5, -1)):
        want = 32 * len(set(range(low, high + 1)) & set(range(100)))
        assert R.range_selection(engine.table("c"), "k", low, high).count() == want
    ordered = [r.k for r in R.range_selection(engine.table("c"), "k", 3, 6, ordered=True).collect()]
    assert ordered == sorted(ordered) and len(ordered) == 128
    engine.catalog.recluster("c")
    assert engine.table("c").count() == 3200
    with pytest.raises(CatalogError):
        engine.catalog.create(parse("create table d (a int) as bplustree on b"))


def test_catalog_persists_and_replaces(engine, spark, tmp_path):
    engine.execute("create table t (a INT)", lambda _: None)
    engine.execute("create table t (b STRING, c DOUBLE)", lambda _: None)
    engine.catalog.put("list", ["x", "y"])
    assert engine.catalog.statistics("t") is None
    assert engine.execute("exit", lambda _: None) is False
    again = Catalog(spark, str(tmp_path / "db"))
    assert again.names() == ["t"] and again.info("t").schema == {"b": "string", "c": "double"} and again.get("list") == ["x", "y"]
    with pytest.raises(CatalogError):
        again.table("nothing")


def test_script(engine, tmp_path):
    source = text_file(tmp_path, "n.tbl", [f"{i}|name {i % 2}|" for i in range(50)])
    said = []
    engine.run(
        ["create table n (k INT, name STRING);", f"load n from {source}; junk", "select a.name, sum(1)", "from n as a", "group by a.name;", "select b.q from n as a;", "select a.k from n as a;", "exit;", "select"],
        said.append,
    )
    assert sorted(said[2:4]) == ["name 0|25|", "name 1|25|"]
    assert said[4].startswith("IDENTIFIER: Table")
    assert len(said) == 5 + 30
    assert engine.cost("select a.k from n as a where a.k = 1") == pytest.approx(1.0, rel=0.1)


def test_statistics_order_joins(engine, tmp_path):
    engine.execute("create table big (k INT)", lambda _: None)
    engine.execute("create table small (k INT)", lambda _: None)
    engine.load("big", text_file(tmp_path, "b.tbl", [f"{i}|" for i in range(100)]))
    engine.load("small", text_file(tmp_path, "s.tbl", ["3|", "4|"]))
    assert sorted(r[0] for r in engine.sql("select a.k from big as a, small as b where a.k = b.k").collect()) == [3, 4]


def test_init_loads_what_the_catalog_has(engine, tmp_path):
    engine.execute("create table region (r_regionkey INT, r_name STRING)", lambda _: None)
    text_file(tmp_path, "region.tbl", ["0|AFRICA|", "1|ASIA|"])
    engine.init(str(tmp_path))
    assert engine.table("region").count() == 2


@pytest.mark.parametrize("strategy, node", [("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("hash", "ShuffledHashJoin")])
def test_join_strategies(spark, strategy, node):
    left, right = spark.range(10).toDF("a"), spark.range(5, 15).toDF("b")
    joined = R.join(left, right, [("[a]", "[b]")], strategy=strategy)
    assert node in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.a for r in joined.collect()) == list(range(5, 10))


def test_filters_and_columns_reach_the_scan(spark, sf):
    engine = Engine.over_parquet(spark, sf, ["lineitem"])
    plan = engine.sql('select l.l_orderkey from lineitem as l where l.l_returnflag = "R" and l.l_shipdate = "1996-05-12"')._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "EqualTo(l_shipdate," in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan


def test_continuous_load(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text_file(folder, "1.tbl", ["1|a|", "2|b|"])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        streaming.load_available(streaming.text_stream(spark, str(folder), {"i": Kind.INT, "s": Kind.STRING}), out, state).awaitTermination(60)
    text_file(folder, "2.tbl", ["3|c|"])
    streaming.load_available(streaming.text_stream(spark, str(folder), {"i": Kind.INT, "s": Kind.STRING}), out, state).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_stretches_of_a_scan(spark, engine):
    df = spark.range(0, 100, 1, 4)
    assert sorted(r.id for r in scan.partition_range(df, 1, 2).collect()) == list(range(25, 75))
    assert sum(r.id for r in scan.iterate(df)) == 4950
    engine.execute("create table t (a INT)", lambda _: None)
    engine.catalog.write("t", df.select(F.col("id").cast("int").alias("a")))
    engine.catalog.append("t", df.limit(1).select(F.col("id").cast("int").alias("a")))
    assert engine.table("t").count() == 101
    engine.catalog.clear("t")
    assert engine.table("t").count() == 0 and engine.catalog.statistics("t") is None


def test_stretches_read_their_files_only(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(0, 100, 1, 1).write.option("maxRecordsPerFile", 10).parquet(path)
    table = spark.read.parquet(path)
    chosen = scan.stretches(table, [(1, 2), (7, 20)])
    assert sorted(r.id for r in chosen.collect()) == [*range(10, 30), *range(70, 100)]
    assert len(chosen.inputFiles()) == 5
    assert scan.stretches(table, []).count() == 0 == scan.stretches(table, [(50, 60)]).count()
    assert scan.stretches(table, [(0, 1), (1, 1)]).count() == 30


def test_catalog_under_a_scheme(spark, tmp_path):
    """Roots with a scheme, reclustering into a new folder, and a side file whose last renaming didn't happen."""
    root = f"file://{tmp_path}/db"
    catalog = Catalog(spark, root)
    catalog.create(parse("create table t (k int) as bplustree on k"))
    catalog.write("t", spark.createDataFrame([(3,), (1,)], "k int"))
    before = catalog.path("t")
    catalog.recluster("t")
    assert catalog.path("t") != before and not catalog.files.exists(before)
    assert sorted(r.k for r in Catalog(spark, root).table("t").collect()) == [1, 3]
    (tmp_path / "db" / "catalog.json").rename(tmp_path / "db" / "catalog.json.0123")
    assert Catalog(spark, root).names() == ["t"]
