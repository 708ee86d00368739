"""The relational queries by name, each with its DuckDB equivalent.

Queries q00 to q12 are the benchmark's (fixed values: their texts), adapted to the tables at hand; the rest show one operator each. Texts of the dialect run through the
engine; the others use the operators. Sums of money are taken over decimals, so that they don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnlake.functions.expr import Kind, kind_of
from tarnlake.operators import relops as R
from tarnlake.plans.lexer import ParseError
from tarnlake.plans.parser import CreateTable, parse
from tarnlake.plans.session import Engine
from tarnlake.sources import stats, textio
from tarnlake.sources.catalog import Catalog
from tarnlake.sources.scan import iterate, stretches
from tarnlake.sources.scratch import scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


_QUERIES: dict[str, Query] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dialect(name: str, text: str, oracle: str) -> None:
    """A query in the dialect."""
    _QUERIES[name] = Query(lambda spark, sf_dir: Engine.over_parquet(spark, sf_dir, TABLES).sql(text), oracle)


def _query(oracle: str | None):
    """Registers a function over (spark-bound table reader)."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        _QUERIES[f.__name__] = Query(lambda spark, sf_dir: f(lambda name: _table(spark, sf_dir, name)), oracle)
        return f

    return add


def _money(c: str, scale: int = 2):
    return F.col(c).cast(f"decimal(12,{scale})")


_dialect(
    "q00_join2",
    'select c.c_name, n.n_name from customer as c, nation as n where (c.c_nationkey = n.n_nationkey) and (n.n_name = "NATION_5")',
    "select c_name as output_0, n_name as output_1 from customer join nation on c_nationkey = n_nationkey where n_name = 'NATION_5'",
)
_dialect(
    "q01_filter_eq",
    'select l.l_orderkey from lineitem as l where (l.l_shipdate = "1996-05-12") and (l.l_returnflag = "R")',
    "select l_orderkey as output_0 from lineitem where l_shipdate = timestamp '1996-05-12' and l_returnflag = 'R'",
)
_dialect(
    "q02_filter_arith",
    'select l.l_orderkey from lineitem as l where (l.l_linestatus = "F") and (l.l_extendedprice / l.l_quantity > 1759.6) and (l.l_extendedprice / l.l_quantity < 1859.8)',
    "select l_orderkey as output_0 from lineitem where l_linestatus = 'F' and l_extendedprice / l_quantity > 1759.6::double and l_extendedprice / l_quantity < 1859.8::double",
)


@_query(
    """select count(*) as n_orders, (cast(sum(cast(o_totalprice as decimal(12,2))) as double) / count(*) - 32592.14::double) / 32592.14::double as relative_price
    from orders where o_orderstatus = 'F' and (o_orderpriority < '2-HIGH' or o_orderpriority = '2-HIGH') having count(*) > 0"""
)
def q03_global_agg(t):
    kept = R.selection(t("orders"), ["== ([o_orderstatus], string[F])", "|| (< ([o_orderpriority], string[2-HIGH]), == ([o_orderpriority], string[2-HIGH]))"])
    total = R.aggregate(kept, {"n_orders": ("count", "int[1]"), "total": ("sum", _money("o_totalprice"))})
    return total.select("n_orders", ((F.col("total").cast("double") / F.col("n_orders") - 32592.14) / 32592.14).alias("relative_price"))


@_query(
    """select cast(sum(cast(o_totalprice as decimal(12,2))) as double) / count(*) as avg_price, 'order priority was ' || o_orderpriority as label
    from orders where o_orderstatus = 'F' group by o_orderpriority"""
)
def q04_group_concat(t):
    grouped = R.aggregate(t("orders"), {"n": ("count", "int[1]"), "total": ("sum", _money("o_totalprice"))}, {"o_orderpriority": "[o_orderpriority]"}, "== ([o_orderstatus], string[F])")
    return grouped.select((F.col("total").cast("double") / F.col("n")).alias("avg_price"), R.column(grouped, "+ (string[order priority was ], [o_orderpriority])").alias("label"))


@_query(
    """select 'return flag was ' || l_returnflag as label, cast(sum(cast(l_quantity as decimal(12,2))) as double) as sum_qty,
    cast(sum(cast(l_extendedprice as decimal(12,2))) as double) as sum_price,
    cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as sum_disc,
    cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) * (1 + cast(l_tax as decimal(4,2)))) as double) as sum_charge,
    cast(sum(cast(l_quantity as decimal(12,2))) as double) / count(*) as avg_qty, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) / count(*) as avg_price,
    cast(sum(cast(l_discount as decimal(12,2))) as double) / count(*) as avg_disc, count(*) as n
    from lineitem where l_shipdate < timestamp '1998-12-01' and l_shipdate > timestamp '1998-06-01' group by l_returnflag"""
)
def q05_pricing(t):
    price, disc, tax = _money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    kept = t("lineitem").filter((F.col("l_shipdate") < F.lit("1998-12-01").cast("timestamp_ntz")) & (F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp_ntz")))
    g = kept.groupBy("l_returnflag").agg(
        F.sum(_money("l_quantity")).cast("double").alias("sum_qty"),
        F.sum(price).cast("double").alias("sum_price"),
        F.sum(price * (1 - disc)).cast("double").alias("sum_disc"),
        F.sum(price * (1 - disc) * (1 + tax)).cast("double").alias("sum_charge"),
        F.sum(_money("l_discount")).cast("double").alias("discounts"),
        F.count(F.lit(1)).alias("n"),
    )
    per_row = lambda c: F.col(c) / F.col("n")
    return g.select(
        R.column(g, "+ (string[return flag was ], [l_returnflag])").alias("label"), "sum_qty", "sum_price", "sum_disc", "sum_charge",
        per_row("sum_qty").alias("avg_qty"), per_row("sum_price").alias("avg_price"), per_row("discounts").alias("avg_disc"), "n",
    )


_dialect(
    "q06_join_group",
    'select l.l_linestatus, sum(1) from orders as o, lineitem as l where (o.o_orderkey = l.l_orderkey) and (o.o_orderstatus = "F") and (l.l_returnflag = "A" or l.l_returnflag = "R") and (o.o_orderdate < l.l_shipdate) group by l.l_linestatus',
    "select l_linestatus as output_0, count(*) as output_1 from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'F' and l_returnflag in ('A', 'R') and o_orderdate < l_shipdate group by l_linestatus",
)


@_query(
    """select l_partkey, cast(sum(cast(l_extendedprice as decimal(12,2))) as double) / count(*) as avg_price from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'AMERICA' group by l_partkey"""
)
def q07_join5(t):
    places = R.join(t("nation"), t("region"), [("[n_regionkey]", "[r_regionkey]")], right_predicate="== ([r_name], string[AMERICA])")
    sellers = R.join(t("supplier"), places, [("[s_nationkey]", "[n_nationkey]")]).select("s_suppkey")
    lines = R.join(t("lineitem"), sellers, [("[l_suppkey]", "[s_suppkey]")])
    found = R.join(lines, t("part"), [("[l_partkey]", "[p_partkey]")]).groupBy("l_partkey").agg(F.sum(_money("l_extendedprice")).alias("total"), F.count(F.lit(1)).alias("n"))
    return found.select("l_partkey", (F.col("total").cast("double") / F.col("n")).alias("avg_price"))


_dialect(
    "q08_join5_expr",
    """select n.n_name, o.o_orderdate, l.l_extendedprice * (1 - l.l_discount) - p.p_retailprice * l.l_quantity from part as p, supplier as s, lineitem as l, orders as o, nation as n
    where (s.s_suppkey = l.l_suppkey) and (p.p_partkey = l.l_partkey) and (o.o_orderkey = l.l_orderkey) and (s.s_nationkey = n.n_nationkey) and (p.p_type = "STANDARD" or p.p_type = "ECONOMY")""",
    """select n_name as output_0, o_orderdate as output_1, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity as output_2 from lineitem join part on p_partkey = l_partkey
    join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join nation on s_nationkey = n_nationkey where p_type in ('STANDARD', 'ECONOMY')""",
)
_Q09 = """select "supplier name was " + s.s_name, sum(1) from supplier as s, lineitem as l1, lineitem as l2, orders as o, nation as n where (s.s_suppkey = l1.l_suppkey) and (o.o_orderkey = l1.l_orderkey)
    and (o.o_orderstatus = "F") and (l1.l_shipdate > o.o_orderdate) and (l2.l_orderkey = l1.l_orderkey) and (not l2.l_suppkey = l1.l_suppkey) {} group by s.s_name"""
_Q09_SQL = """select 'supplier name was ' || s_name as output_0, count(*) as output_1 from supplier join lineitem l1 on s_suppkey = l1.l_suppkey join orders on o_orderkey = l1.l_orderkey
    join lineitem l2 on l2.l_orderkey = l1.l_orderkey {} where o_orderstatus = 'F' and l1.l_shipdate > o_orderdate and l2.l_suppkey <> l1.l_suppkey group by s_name"""
_dialect("q09_selfjoin_not", _Q09.format("and (s.s_nationkey = n.n_nationkey)"), _Q09_SQL.format("join nation on s_nationkey = n_nationkey"))
_dialect("q09_unconnected", _Q09.format(""), _Q09_SQL.format("cross join nation"))


@_query(
    """select 'date was ' || strftime(o_orderdate, '%Y-%m-%d') as label, cast(sum(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) / count(*) as avg_revenue
    from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation n1 on c_nationkey = n1.n_nationkey join region r1 on n1.n_regionkey = r1.r_regionkey join nation n2 on s_nationkey = n2.n_nationkey join region r2 on n2.n_regionkey = r2.r_regionkey
    where r1.r_name = 'AMERICA' and r2.r_name = 'MIDDLE EAST' and p_type = 'ECONOMY' and o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-12-31' group by o_orderdate"""
)
def q10_join9(t):
    def within(region):
        places = R.join(t("nation"), t("region"), [("[n_regionkey]", "[r_regionkey]")], right_predicate=f"== ([r_name], string[{region}])")
        return places.select("n_nationkey")

    day = lambda s: F.lit(s).cast("timestamp_ntz")
    buyers = R.join(t("customer"), within("AMERICA"), [("[c_nationkey]", "[n_nationkey]")]).select("c_custkey")
    sellers = R.join(t("supplier"), within("MIDDLE EAST"), [("[s_nationkey]", "[n_nationkey]")]).select("s_suppkey")
    orders = R.join(t("orders").filter(F.col("o_orderdate").between(day("1995-01-01"), day("1996-12-31"))), buyers, [("[o_custkey]", "[c_custkey]")])
    parts = R.selection(t("part"), "== ([p_type], string[ECONOMY])", {"p_partkey": "[p_partkey]"})
    lines = R.join(R.join(t("lineitem"), parts, [("[l_partkey]", "[p_partkey]")]), sellers, [("[l_suppkey]", "[s_suppkey]")])
    rows = R.join(lines, orders, [("[l_orderkey]", "[o_orderkey]")])
    g = rows.groupBy("o_orderdate").agg(F.sum(_money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("total"), F.count(F.lit(1)).alias("n"))
    return g.select(R.column(g, "+ (string[date was ], [o_orderdate])").alias("label"), (F.col("total").cast("double") / F.col("n")).alias("avg_revenue"))


_dialect(
    "q11_cross",
    """select l1.l_linestatus, sum(1) from orders as o, lineitem as l1, lineitem as l2, customer as c, nation as n where (o.o_orderkey = l1.l_orderkey) and (o.o_orderkey = l1.l_orderkey) and (o.o_orderstatus = "F")
    and (l1.l_shipdate = "1996-06-20") and (l2.l_shipdate = "1996-06-21") and (c.c_custkey = o.o_custkey) and (n.n_nationkey = c.c_nationkey) and (n.n_regionkey = 1) group by l1.l_linestatus""",
    """select l1.l_linestatus as output_0, count(*) as output_1 from orders join lineitem l1 on o_orderkey = l1.l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
    cross join lineitem l2 where o_orderstatus = 'F' and l1.l_shipdate = timestamp '1996-06-20' and l2.l_shipdate = timestamp '1996-06-21' and n_regionkey = 1 group by l1.l_linestatus""",
)
_dialect(
    "q12_selfjoin7",
    """select "both customers purchased part " + p.p_name from part as p, orders as o1, orders as o2, lineitem as l1, lineitem as l2, customer as c1, customer as c2 where (l1.l_partkey = l2.l_partkey)
    and (o1.o_orderkey = l1.l_orderkey) and (o2.o_orderkey = l2.l_orderkey) and (o1.o_custkey = c1.c_custkey) and (o2.o_custkey = c2.c_custkey) and (c1.c_name = "Customer#000000007")
    and (c2.c_name = "Customer#000001017") and (p.p_partkey = l2.l_partkey)""",
    """select 'both customers purchased part ' || p_name as output_0 from lineitem l1 join lineitem l2 on l1.l_partkey = l2.l_partkey join orders o1 on o1.o_orderkey = l1.l_orderkey
    join orders o2 on o2.o_orderkey = l2.l_orderkey join customer c1 on o1.o_custkey = c1.c_custkey join customer c2 on o2.o_custkey = c2.c_custkey join part on p_partkey = l2.l_partkey
    where c1.c_name = 'Customer#000000007' and c2.c_name = 'Customer#000001017'""",
)

# The same benchmark queries as texts of the dialect. Sums and averages of doubles depend on the order of rows in their last bits, so they are rounded.


def _rounded(name: str, text: str, oracle: str, digits: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Engine.over_parquet(spark, sf_dir, TABLES).sql(text)
        return found.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in found.dtypes))

    _QUERIES[name] = Query(run, oracle)


_rounded(
    "sql03_global_agg",
    'select sum(1), avg((o.o_totalprice - 32592.14) / 32592.14) from orders as o where (o.o_orderstatus = "F") and (o.o_orderpriority < "2-HIGH" or o.o_orderpriority = "2-HIGH")',
    "select count(*) as output_0, round(avg((o_totalprice - 32592.14::double) / 32592.14::double), 6) as output_1 from orders where o_orderstatus = 'F' and o_orderpriority <= '2-HIGH' having count(*) > 0",
    6,
)
_rounded(
    "sql04_group_concat",
    'select avg(o.o_totalprice), "order priority was " + o.o_orderpriority from orders as o where (o.o_orderstatus = "F") group by o.o_orderpriority',
    "select round(avg(o_totalprice), 4) as output_0, 'order priority was ' || o_orderpriority as output_1 from orders where o_orderstatus = 'F' group by o_orderpriority",
    4,
)
_rounded(
    "sql05_pricing",
    """select "return flag was " + l.l_returnflag, sum(l.l_quantity), sum(l.l_extendedprice), sum(l.l_extendedprice * (1 - l.l_discount)), sum(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)),
    avg(l.l_quantity), avg(l.l_extendedprice), avg(l.l_discount), sum(1) from lineitem as l where (l.l_shipdate < "1998-12-01") and (l.l_shipdate > "1998-06-01") group by l.l_returnflag""",
    """select 'return flag was ' || l_returnflag as output_0, round(sum(l_quantity), 2) as output_1, round(sum(l_extendedprice), 2) as output_2, round(sum(l_extendedprice * (1 - l_discount)), 2) as output_3,
    round(sum(l_extendedprice * ((1 - l_discount) * (1 + l_tax))), 2) as output_4, round(avg(l_quantity), 2) as output_5, round(avg(l_extendedprice), 2) as output_6, round(avg(l_discount), 2) as output_7,
    count(*) as output_8 from lineitem where l_shipdate < timestamp '1998-12-01' and l_shipdate > timestamp '1998-06-01' group by l_returnflag""",
    2,
)
_rounded(
    "sql07_join5",
    """select l.l_partkey, avg(l.l_extendedprice) from part as p, lineitem as l, supplier as s, nation as n, region as r where (p.p_partkey = l.l_partkey) and (s.s_suppkey = l.l_suppkey)
    and (s.s_nationkey = n.n_nationkey) and (n.n_regionkey = r.r_regionkey) and (r.r_name = "AMERICA") group by l.l_partkey""",
    """select l_partkey as output_0, round(avg(l_extendedprice), 4) as output_1 from part join lineitem on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on s_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey where r_name = 'AMERICA' group by l_partkey""",
    4,
)
_rounded(
    "sql10_join9",
    """select "date was " + o.o_orderdate, avg(l.l_extendedprice * (1 - l.l_discount)) from part as p, supplier as s, lineitem as l, orders as o, customer as c, nation as n1, nation as n2, region as r1, region as r2
    where (p.p_partkey = l.l_partkey) and (s.s_suppkey = l.l_suppkey) and (l.l_orderkey = o.o_orderkey) and (o.o_custkey = c.c_custkey) and (c.c_nationkey = n1.n_nationkey) and (n1.n_regionkey = r1.r_regionkey)
    and (r1.r_name = "AMERICA") and (n2.n_regionkey = r2.r_regionkey) and (r2.r_name = "MIDDLE EAST") and (s.s_nationkey = n2.n_nationkey) and (o.o_orderdate > "1995-01-01" or o.o_orderdate = "1995-01-01")
    and (o.o_orderdate < "1996-12-31" or o.o_orderdate = "1996-12-31") and (p.p_type = "ECONOMY") group by o.o_orderdate""",
    """select 'date was ' || strftime(o_orderdate, '%Y-%m-%d') as output_0, round(avg(l_extendedprice * (1 - l_discount)), 4) as output_1 from lineitem join part on p_partkey = l_partkey
    join supplier on s_suppkey = l_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation n1 on c_nationkey = n1.n_nationkey join region r1 on n1.n_regionkey = r1.r_regionkey
    join nation n2 on s_nationkey = n2.n_nationkey join region r2 on n2.n_regionkey = r2.r_regionkey where r1.r_name = 'AMERICA' and r2.r_name = 'MIDDLE EAST' and p_type = 'ECONOMY'
    and o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-12-31' group by o_orderdate""",
    4,
)

# Scans, projections and predicates.


@_query("select r_regionkey, r_name from region")
def scan(t):
    return t("region").select("r_regionkey", "r_name")


@_query("select s_name, cast(s_nationkey as varchar) as nation_text, s_name || ' ' || printf('%.6f', s_acctbal) || ' ' || cast(s_nationkey as varchar) as combined from supplier where s_nationkey = 1")
def sel_computed(t):
    return R.selection(
        t("supplier"),
        "== ([s_nationkey], int[1])",
        {"s_name": "[s_name]", "nation_text": "+ ([s_nationkey], string[])", "combined": "+ (+ (+ ([s_name], string[ ]), + ([s_acctbal], string[ ])), [s_nationkey])"},
    )


@_query("select o_orderkey, o_totalprice from orders where o_orderkey between 100 and 700 and o_orderstatus = 'F'")
def range_sel(t):
    return R.range_selection(t("orders"), "o_orderkey", 100, 700, "== ([o_orderstatus], string[F])", {"o_orderkey": "[o_orderkey]", "o_totalprice": "[o_totalprice]"})


@_query("select o_orderkey, o_custkey from orders where o_orderkey between 250 and 500 order by o_orderkey")
def range_sel_sorted(t):
    return R.range_selection(t("orders"), "o_orderkey", 250, 500, ordered=True).select("o_orderkey", "o_custkey")


@_query("select c_name from customer where c_name between 'Customer#000000010' and 'Customer#000000099'")
def range_sel_text_key(t):
    return R.range_selection(t("customer"), "c_name", "Customer#000000010", "Customer#000000099", projections={"c_name": "[c_name]"})


@_query("select o_orderkey from orders where (o_orderstatus = 'F' or o_orderpriority = '1-URGENT') and not o_totalprice > 100000 and true")
def bool_ops(t):
    return R.selection(
        t("orders"), "&& (&& (|| (== ([o_orderstatus], string[F]), == ([o_orderpriority], string[1-URGENT])), ! (> ([o_totalprice], double[100000.0]))), bool[true])", {"o_orderkey": "[o_orderkey]"}
    )


@_query("select p_partkey, p_size > 10 as above, p_size < 10 as below, p_size = 10 as equal, p_size <> 10 as other from part")
def comparisons(t):
    p = "([p_size], int[10])"
    return R.selection(t("part"), None, {"p_partkey": "[p_partkey]", "above": f"> {p}", "below": f"< {p}", "equal": f"== {p}", "other": f"!= {p}"})


@_query("select p_partkey, p_partkey // 7 as quotient, (0 - p_size) // 7 as negative_quotient from part")
def int_div(t):
    return R.selection(t("part"), None, {"p_partkey": "[p_partkey]", "quotient": "/ ([p_partkey], int[7])", "negative_quotient": "/ (um ([p_size]), int[7])"})


@_query("select s_suppkey, -s_suppkey as minus_key, -s_acctbal as minus_balance from supplier")
def neg(t):
    return R.selection(t("supplier"), None, {"s_suppkey": "[s_suppkey]", "minus_key": "um ([s_suppkey])", "minus_balance": "um ([s_acctbal])"})


@_query("select l_orderkey, l_linenumber, l_extendedprice - l_quantity * 2.5::double as difference, l_quantity + l_linenumber as total from lineitem")
def arithmetic(t):
    return R.selection(
        t("lineitem"), None, {"l_orderkey": "[l_orderkey]", "l_linenumber": "[l_linenumber]", "difference": "- ([l_extendedprice], * ([l_quantity], double[2.5]))", "total": "+ ([l_quantity], [l_linenumber])"}
    )


@_query("select 'key ' || cast(p_partkey as varchar) || ' ' || printf('%.6f', p_retailprice) || case when p_size > 20 then 'true' else 'false' end as text from part")
def concat_mixed(t):
    return R.selection(t("part"), None, {"text": "+ (+ (string[key ], + ([p_partkey], string[ ])), + ([p_retailprice], + (string[], > ([p_size], int[20]))))"})


@_query("select l_orderkey, l_linenumber from lineitem where cast(l_linenumber as varchar) < '3'")
def compare_as_text(t):
    return R.selection(t("lineitem"), "< ([l_linenumber], string[3])", {"l_orderkey": "[l_orderkey]", "l_linenumber": "[l_linenumber]"})


_dialect(
    "right_assoc",
    "select p.p_partkey - p.p_size - 1, p.p_size / 2 * 3 from part as p",
    "select p_partkey - (p_size - 1) as output_0, p_size // (2 * 3) as output_1 from part",
)
_dialect(
    "not_equal",
    'select n.n_name, r.r_name from nation as n, region as r where (n.n_regionkey <> r.r_regionkey) and (n.n_nationkey < 3)',
    "select n_name as output_0, r_name as output_1 from nation, region where n_regionkey <> r_regionkey and n_nationkey < 3",
)

# Joins.

_PAIRS_SQL = "select o_orderkey, l_linenumber, c_name from orders join lineitem on o_orderkey = l_orderkey join customer on o_custkey = c_custkey where o_orderstatus = 'P' and l_returnflag = 'N'"


def _pairs(strategy: str):
    def run(t):
        lines = R.join(t("orders"), t("lineitem"), [("[o_orderkey]", "[l_orderkey]")], left_predicate="== ([o_orderstatus], string[P])", right_predicate="== ([l_returnflag], string[N])", strategy=strategy)
        return R.join(lines, t("customer"), [("[o_custkey]", "[c_custkey]")], strategy=strategy).select("o_orderkey", "l_linenumber", "c_name")

    run.__name__ = {"broadcast": "join_broadcast", "merge": "join_merge", "hash": "join_shuffle_hash", "auto": "join_auto"}[strategy]
    return run


for _strategy in ("broadcast", "merge", "hash", "auto"):
    _query(_PAIRS_SQL)(_pairs(_strategy))


@_query("select s_name, c_name from supplier join customer on s_nationkey = c_nationkey and s_suppkey // 10 = c_custkey // 100")
def join_expr_key(t):
    return R.join(t("supplier"), t("customer"), [("[s_nationkey]", "[c_nationkey]"), ("/ ([s_suppkey], int[10])", "/ ([c_custkey], int[100])")], projections={"s_name": "[s_name]", "c_name": "[c_name]"})


@_query("select s_name, c_name from supplier join customer on s_nationkey = c_nationkey where s_acctbal > c_acctbal")
def join_residual(t):
    return R.join(t("supplier"), t("customer"), [("[s_nationkey]", "[c_nationkey]")], "> ([s_acctbal], [c_acctbal])", {"s_name": "[s_name]", "c_name": "[c_name]"})


@_query("select r_name, n_name from region cross join nation")
def cross_join(t):
    return R.cross_join(t("region"), t("nation"), {"r_name": "[r_name]", "n_name": "[n_name]"})


@_query("select s_name, n_name from supplier join nation on s_nationkey < n_nationkey or s_acctbal < n_regionkey")
def theta_join(t):
    return R.theta_join(t("supplier"), t("nation"), "|| (< ([s_nationkey], [n_nationkey]), < ([s_acctbal], [n_regionkey]))", {"s_name": "[s_name]", "n_name": "[n_name]"})


@_query("select a.n_name as one, b.n_name as other from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def self_join(t):
    renamed = lambda p: t("nation").select(*(F.col(c).alias(f"{p}_{c}") for c in ("n_nationkey", "n_name", "n_regionkey")))
    return R.join(renamed("a"), renamed("b"), [("[a_n_regionkey]", "[b_n_regionkey]")], "< ([a_n_nationkey], [b_n_nationkey])", {"one": "[a_n_name]", "other": "[b_n_name]"})


# Aggregation.


@_query("select l_returnflag, count(*) as n from lineitem group by l_returnflag")
def agg_count(t):
    return R.aggregate(t("lineitem"), {"n": ("count", "[l_orderkey]")}, {"l_returnflag": "[l_returnflag]"})


@_query("select o_custkey // 100 as bucket, count(*) as n, cast(sum(o_orderkey) as bigint) as keys, cast(sum(o_orderkey) // count(*) as bigint) as avg_key from orders group by o_custkey // 100")
def agg_group_expr(t):
    return R.aggregate(t("orders"), {"n": ("count", "int[1]"), "keys": ("sum", "[o_orderkey]"), "avg_key": ("avg", "[o_orderkey]")}, {"bucket": "/ ([o_custkey], int[100])"})


@_query("select s_nationkey, count(*) as n, cast(sum(s_suppkey) // count(*) as bigint) as avg_key from supplier where s_acctbal > 0 group by s_nationkey")
def avg_int(t):
    return R.aggregate(t("supplier"), {"n": ("count", "int[1]"), "avg_key": ("avg", "[s_suppkey]")}, {"s_nationkey": "[s_nationkey]"}, "> ([s_acctbal], double[0.0])")


@_query("select cast(sum(n) as bigint) as total from (select o_custkey // 100 as bucket, count(*) as n from orders group by 1)")
def agg_of_agg(t):
    return R.aggregate(agg_group_expr(t), {"total": ("sum", "[n]")})


@_query("select cast(count(*) as bigint) as n from orders where o_orderkey < -1 having count(*) > 0")
def agg_empty(t):
    return R.aggregate(t("orders"), {"n": ("count", "int[1]")}, predicate="< ([o_orderkey], int[-1])")


_dialect(
    "group_not_selected",
    'select sum(1) from lineitem as l, orders as o where (l.l_orderkey = o.o_orderkey) and (o.o_orderstatus = "P") group by l.l_linenumber',
    "select count(*) as output_0 from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'P' group by l_linenumber",
)
_dialect("agg_in_arithmetic", "select 1 + sum(n.n_nationkey) from nation as n", "select cast(1 + sum(n_nationkey) as bigint) as output_0 from nation")
_dialect("agg_no_where_group", "select n.n_regionkey, sum(1) from nation as n group by n.n_regionkey", "select n_regionkey as output_0, count(*) as output_1 from nation group by n_regionkey")

# Sort, statistics, text.


@_query("select o_orderkey, o_totalprice from orders order by o_totalprice * 2 - o_custkey")
def sort_expr(t):
    return R.sort(t("orders"), "- (* ([o_totalprice], int[2]), [o_custkey])").select("o_orderkey", "o_totalprice")


@_query("select c_custkey, c_acctbal from customer where c_acctbal > 0 order by c_acctbal")
def sort_filtered(t):
    return R.sort(t("customer"), "[c_acctbal]", "> ([c_acctbal], double[0.0])").select("c_custkey", "c_acctbal")


def _rows_of(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _catalog(spark: SparkSession) -> Catalog:
    """An empty catalog in the shared folder."""
    return Catalog(spark, scratch_path(spark, "catalog"))


def _table_of(catalog: Catalog, name: str, df: DataFrame, sort_attribute: str | None = None) -> None:
    """A table of the catalog with a DataFrame's columns and rows."""
    catalog.create(CreateTable(name, tuple((f.name, kind_of(f.dataType)) for f in df.schema.fields), sort_attribute))
    catalog.write(name, df)


@_query("select s_name || '|' as line from supplier order by s_name limit 30")
def display_limit(t):
    names = t("supplier").select("s_name").orderBy("s_name")
    return _rows_of(names.sparkSession, [(x,) for x in Engine.display(names)], "line string")


@_query("select count(*) as n_rows from lineitem")
def tuple_count(t):
    lines = t("lineitem").select("l_orderkey")
    return _rows_of(lines.sparkSession, [(int(stats.measure(lines).rows),)], "n_rows long")


@_query(None)
def approx_distinct(t):
    return stats.distinct_counts(t("lineitem"))


@_query("select true as rows_exact, true as distinct_within_a_sixth")
def approx_distinct_within(t):
    """The sketch's estimates against exact counts."""
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    lines = t("lineitem").select(*columns)
    exact = lines.agg(F.count(F.lit(1)).alias("n"), *(F.countDistinct(c).alias(f"exact_{c}") for c in columns))
    near = [F.abs(F.col(c) - F.col(f"exact_{c}")) * 6 <= F.col(f"exact_{c}") for c in columns]
    return stats.distinct_counts(lines).crossJoin(exact).select((F.col("n_rows") == F.col("n")).alias("rows_exact"), reduce(lambda a, b: a & b, near).alias("distinct_within_a_sixth"))


@_query("select cast(s_suppkey as varchar) || '|' || s_name || '|' || cast(s_nationkey as varchar) || '|' || printf('%.6f', s_acctbal) || '|' as value from supplier")
def text_dump(t):
    return textio.lines(t("supplier"))


@_query("select cast(n_nationkey as integer) as n_nationkey, n_name, cast(n_regionkey as integer) as n_regionkey from nation")
def text_round_trip(t):
    nation = t("nation")
    path = scratch_path(nation.sparkSession, "nation")
    textio.write_text(nation, path)
    return textio.read_text(nation.sparkSession, path, {f.name: kind_of(f.dataType) for f in nation.schema.fields})


@_query("select o_orderkey, o_totalprice from orders where o_orderkey between 1000 and 1200")
def clustered_range(t):
    orders = t("orders").select("o_orderkey", "o_totalprice")
    catalog = _catalog(orders.sparkSession)
    _table_of(catalog, "orders", orders, "o_orderkey")
    return R.range_selection(catalog.table("orders"), "o_orderkey", 1000, 1200)


@_query("select cast(n_nationkey as integer) as n_nationkey, n_name from nation union all select cast(n_nationkey as integer), n_name from nation where n_nationkey < 5")
def append_rows(t):
    nation = t("nation").select("n_nationkey", "n_name")
    catalog = _catalog(nation.sparkSession)
    _table_of(catalog, "nation", nation)
    catalog.append("nation", nation.filter("n_nationkey < 5"))
    return catalog.table("nation")


@_query("select n_nationkey, n_name from nation where n_nationkey between 5 and 15 union all select n_nationkey, n_name from nation where n_nationkey >= 20")
def scan_stretches(t):
    """Files hold five rows each: the second and third, two rows of the fourth by a filter, and the last."""
    nation = t("nation").select("n_nationkey", "n_name")
    path = scratch_path(nation.sparkSession, "files")
    nation.coalesce(1).sortWithinPartitions("n_nationkey").write.option("maxRecordsPerFile", 5).parquet(path)
    table = nation.sparkSession.read.schema(nation.schema).parquet(path)
    return stretches(table, [(1, 2), (4, 4)]).unionByName(stretches(table, [(3, 3)]).filter("n_nationkey < 16"))


@_query("select cast(k as integer) as k, v from (select distinct n_regionkey as k from nation) cross join (values ('new')) t(v)")
def clear_and_rewrite(t):
    """A cleared table holds what is written after it, clustered tables after reclustering too."""
    nation = t("nation")
    catalog = _catalog(nation.sparkSession)
    keys = nation.select(F.col("n_regionkey").alias("k"), F.lit("old").alias("v"))
    _table_of(catalog, "pairs", keys, "k")
    catalog.clear("pairs")
    catalog.append("pairs", keys.select("k", F.lit("new").alias("v")).distinct())
    catalog.recluster("pairs")
    return Catalog(nation.sparkSession, catalog.root).table("pairs")


@_query("select cast(n_nationkey as integer) as output_0, r_name || ' ' || n_name as output_1 from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'")
def load_and_query(t):
    """Text files loaded by statements, queried through the session, kept by the catalog."""
    spark = t("nation").sparkSession
    catalog = _catalog(spark)
    for name, columns in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"])):
        path = scratch_path(spark, name)
        textio.write_text(t(name).select(*columns), path)
        kinds = ", ".join(f"{f.name} {kind_of(f.dataType).value}" for f in t(name).select(*columns).schema.fields)
        Engine(spark, catalog).run([f"create table {name} ({kinds}) as bplustree on {columns[0]};", f"load {name} from {path};", "exit;"], lambda _: None)
    return Engine(spark, Catalog(spark, catalog.root)).sql('select n.n_nationkey, r.r_name + " " + n.n_name from nation as n, region as r where (n.n_regionkey = r.r_regionkey) and (r.r_name = "ASIA")')


@_query("select 25 as nations, 5 as regions, true as cheaper_in_order")
def statistics_and_cost(t):
    """Measured rows, and that the cost of a filtered join is below that of the unfiltered one."""
    spark = t("nation").sparkSession
    catalog = _catalog(spark)
    for name in ("nation", "region"):
        _table_of(catalog, name, t(name).select(*(f.name for f in t(name).schema.fields if not f.name.endswith("comment"))))
        catalog.measure(name)
    engine, join = Engine(spark, catalog), "select n.n_name from nation as n, region as r where (n.n_regionkey = r.r_regionkey)"
    cheaper = engine.cost(join + ' and (r.r_name = "ASIA")') < engine.cost(join)
    return _rows_of(spark, [(int(catalog.statistics("nation").rows), int(catalog.statistics("region").rows), cheaper)], "nations int, regions int, cheaper_in_order boolean")


@_query("select n_nationkey, n_name from nation where n_nationkey % 2 = 1")
def scan_one_at_a_time(t):
    """Rows taken one after the other, every second one kept."""
    nation = t("nation").select("n_nationkey", "n_name")
    return _rows_of(nation.sparkSession, [tuple(r) for r in iterate(nation) if r.n_nationkey % 2], nation.schema)


@_query("select * from (values ('keys', 'a,b', 2, 'bplustree', 'k')) t(name, listed, number, kind, sorted_by)")
def catalog_values(t):
    """Values and tables that the catalog keeps, read by another one."""
    spark = t("nation").sparkSession
    catalog = _catalog(spark)
    catalog.create(CreateTable("keys", (("k", Kind.INT), ("v", Kind.STRING)), "k"))
    catalog.put("list", ["a", "b"])
    catalog.put("number", 2)
    catalog.save()
    again = Catalog(spark, catalog.root)
    info = again.info(again.names()[0])
    return _rows_of(spark, [(info.name, ",".join(again.get("list")), again.get("number"), info.file_type, info.sort_attribute)], "name string, listed string, number int, kind string, sorted_by string")


@_query("select true as in_order, count(*) as n from orders")
def sort_pages(t):
    """Every partition in order by itself: a row is in order if it isn't below the one before it in its partition."""
    prices = R.sort_partitions(t("orders").select("o_totalprice", "o_custkey"), "- ([o_totalprice], [o_custkey])")

    def checked(batches):
        last = None
        for b in batches:
            key = [p.as_py() - k.as_py() for p, k in zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_pydict({"in_order": [last is None and not i or key[i] >= (key[i - 1] if i else last) for i in range(len(key))]})
            last = key[-1] if key else last

    rows = prices.mapInArrow(checked, "in_order boolean")
    return rows.agg(F.every("in_order").alias("in_order"), F.count(F.lit(1)).alias("n"))


_dialect(
    "identifiers_and_numbers",
    "SELECT n-1_x.n_name, n-1_x.n_nationkey * 2.5e1, n-1_x.n_nationkey + .5 from nation AS n-1_x Where n-1_x.n_nationkey > 2.5 and (NOT n-1_x.n_nationkey > 1.9e1)",
    "select n_name as output_0, n_nationkey * 25::double as output_1, n_nationkey + 0.5::double as output_2 from nation where n_nationkey > 2.5 and n_nationkey <= 19",
)
#: Texts that don't parse, and the line of the error.
_UNPARSED = (("select n.n_name\nfrom nation as n\nwhere n.n_name >", 3), ("select n.n_name ? from nation as n", 1), ("select\n\nfrom nation as n", 3), ("create table t\n(a TEXT)", 2))


@_query("select * from (values " + ", ".join(f"({i}, {line})" for i, (_, line) in enumerate(_UNPARSED)) + ") t(text_number, line)")
def syntax_errors(t):
    found = []
    for i, (text, _) in enumerate(_UNPARSED):
        try:
            parse(text)
        except ParseError as e:
            found.append((i, e.line))
    return _rows_of(t("nation").sparkSession, found, "text_number int, line int")


#: Queries that the checker refuses, and the beginning of what it says.
_REFUSED = (
    ("alias", "select m.n_name from nation as n", "IDENTIFIER: Table {{ m }} is not found"),
    ("attribute", "select n.none from nation as n", "IDENTIFIER: Attribute {{ none }} is not found"),
    ("class", 'select n.n_name from nation as n where (n.n_nationkey = "a")', "EQUAL: Left"),
    ("operand", "select n.n_name * n.n_name from nation as n", "TIMES: "),
    ("zero", "select n.n_nationkey / 0 from nation as n", "DIVIDE: "),
    ("grouping", "select n.n_name, sum(1) from nation as n group by n.n_regionkey", "SELECT: Identifier {{ n.n_name }} is not in grouping"),
    ("table", "select n.n_name from nations as n, nation as m", "IDENTIFIER: Attribute"),
    ("predicate", "select n.n_name from nation as n where (n.n_name - n.n_name > n.n_name)", "MINUS: "),
    ("valid", "select n.n_name from nation as n", "VALID QUERY"),
)


@_query("select * from (values " + ", ".join(f"('{name}', true)" for name, _, _ in _REFUSED) + ") t(rule, as_expected)")
def checker_verdicts(t):
    spark = t("nation").sparkSession
    engine = Engine(spark, frames={"nation": t("nation")})
    return _rows_of(spark, [(name, engine.check(text).startswith(says)) for name, text, says in _REFUSED], "rule string, as_expected boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle for name, q in _QUERIES.items() if q.oracle}
