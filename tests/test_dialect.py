"""Lexer, parser, checker, prefix notation and lowering of the dialect."""

import pytest

from tarnlake.functions import prefix
from tarnlake.functions.expr import Aggregate, Attr, Binary, Kind, Literal, Unary
from tarnlake.plans.checker import VALID, Checker
from tarnlake.plans.estimate import Planner, Statistics, plan_cost, scan_rows, selectivity
from tarnlake.plans.lexer import ParseError, tokens
from tarnlake.plans.parser import CreateTable, parse
from tarnlake.plans.session import Engine, statements

KINDS = {
    "customer": "c_custkey int, c_name string, c_nationkey int, c_acctbal double",
    "orders": "o_orderkey int, o_custkey int, o_orderdate string",
    "lineitem": "l_orderkey int, l_suppkey int, l_quantity int, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate string, l_commitdate string",
    "supplier": "s_suppkey int, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}
SCHEMAS = {t: {c.split()[0]: Kind(c.split()[1]) for c in s.split(", ")} for t, s in KINDS.items()}


def where(text):
    return parse(f"select a.x from t as a where {text}").where


def value(text):
    return parse(f"select {text} from t as a").values[0]


A, B, C = Attr("a", "x"), Attr("a", "y"), Attr("a", "z")


def test_arithmetic_is_right_associative():
    assert value("a.x - a.y - a.z") == Binary("-", A, Binary("-", B, C))
    assert value("a.x / a.y * a.z") == Binary("/", A, Binary("*", B, C))
    assert value("a.x * a.y - a.z") == Binary("-", Binary("*", A, B), C)


def test_identifiers_hold_hyphens_and_numbers_hold_signs():
    assert [t.kind for t in tokens("l_tax-1")] == ["name", "end"]
    assert [(t.kind, t.value) for t in tokens("1-2")][:2] == [("int", 1), ("double", -2.0)]
    with pytest.raises(ParseError):
        parse("select 1-2 from t as a")
    assert value("1 - a.x") == Binary("-", Literal(1, Kind.INT), A)


def test_predicates():
    assert where("(a.x = 1 or a.y < 2) and not a.z > 3") == (
        Binary("||", Binary("==", A, Literal(1, Kind.INT)), Binary("<", B, Literal(2, Kind.INT))),
        Unary("!", Binary(">", C, Literal(3, Kind.INT))),
    )
    assert where("(a.x + 1) * 2 > 3")[0].op == ">"
    assert where("((a.x) = 1)") == (Binary("==", A, Literal(1, Kind.INT)),)
    assert where("a.x <> 1")[0].op == "!="


def test_aggregates_stand_first_only():
    assert value("1 + sum(a.x)") == Binary("+", Literal(1, Kind.INT), Aggregate("sum", A))
    with pytest.raises(ParseError):
        value("sum(a.x) + 1")


def test_create_table():
    assert parse("CREATE TABLE t (a INT, b double) AS bplustree ON a") == CreateTable("t", (("a", Kind.INT), ("b", Kind.DOUBLE)), "a")
    assert parse("create table t (a string)").sort_attribute is None


def test_error_has_its_line():
    with pytest.raises(ParseError) as e:
        parse("select a.x\nfrom t as a\nwhere a.x >")
    assert e.value.line == 3
    with pytest.raises(ParseError, match="invalid character"):
        parse("select a.x ? from t as a")


def test_statements_end_at_the_first_semicolon():
    assert list(statements(["select 1", "from t; rest", "exit;"])) == ["select 1\nfrom t", "exit"]


JOINED = "customer as c, orders as o, lineitem as l where (c.c_custkey = o.o_custkey) and (l.l_orderkey = o.o_orderkey)"
REVENUE = "sum(l.l_extendedprice * (1 - l.l_discount))"
SIX = """from customer as c, orders as o, lineitem as l, supplier as s, nation as n, region as r where (c.c_custkey = o.o_custkey) and (l.l_orderkey = o.o_orderkey)
    and (l.l_suppkey = s.s_suppkey) and (c.c_nationkey = s.s_nationkey) and (s.s_nationkey = n.n_nationkey) and (n.n_regionkey = r.r_regionkey) and (r.r_name = "region") {} group by n.n_name"""


@pytest.mark.parametrize(
    "text, says",
    [
        (f"select n.n_name, {REVENUE} " + SIX.format('and (o.o_orderdate > "d" or o.o_orderdate = "d") and (not o.o_orderdate < "e")'), VALID),
        ("select n.n_name, s.s_suppkey, sum(l.l_extendedprice) from nation as n, supplier as s, lineitem as l where (l.l_suppkey = s.s_suppkey) and (s.s_nationkey = n.n_nationkey) group by n.n_name", "SELECT: Identifier"),
        (f'select {REVENUE} from lineitem as l where (l.l_extendedprice * (1 - l.l_discount) > "a string")', "GREATER: "),
        ("select sum(l.l_returnflag + l.l_shipdate + l.l_commitdate) from lineitem as l", "SUM: "),
        ('select l.l_returnflag + l.l_shipdate + l.l_commitdate from lineitem as l where (l.l_shipdate > "a date")', VALID),
        (f"select n.n_name, {REVENUE} " + SIX.format('and (l.l_tax + l.l_discount > "e" or o.o_orderdate = "d")'), "GREATER: "),
        (f"select {REVENUE} from customer as c, orders as o, lineitem as l where (c.c_custkey = o.o_custkey) and (l.l_orderkey = o.k_orderkey)", "IDENTIFIER: Attribute"),
        (f"select {REVENUE} from customer as c, orders as o, lineitem as l where (c.c_custkey = h.o_custkey)", "IDENTIFIER: Table"),
        (f'select {REVENUE} from {JOINED} and ("this" + "that" > 15.0 - "here")', "MINUS: "),
        (f"select {REVENUE} from customers as c, orders as o, lineitem as l where (c.c_custkey = o.o_custkey)", "FROM: Table"),
        (f"select {REVENUE} from {JOINED} and (1200 + l.l_quantity / (300.0 + 34) = 33)", VALID),
        (f'select {REVENUE} from {JOINED} and ("this" + "that" > "here")', VALID),
        (f"select {REVENUE}, sum(c.l_extendedprice * 1.01) from {JOINED}", "IDENTIFIER: Attribute"),
        (f'select {REVENUE} from {JOINED} and ("1204" + "this" = l.l_returnflag) and (l.l_tax + l.l_discount + l.l_extendedprice > 3.27)', VALID),
        (f'select {REVENUE} from {JOINED} and (l.l_tax + l.l_discount + l.l_extendedprice > 3.27 or l.l_discount + l.l_extendedprice > "327")', "GREATER: "),
        (f'select {REVENUE}, sum(1 - l.l_discount) from {JOINED} and (l.l_tax > 3.27 or "here" > "327")', VALID),
        ("select sum(12 + 13.4 + 19), sum(l.l_extendedprice) from lineitem as l", VALID),
    ],
)
def test_check(text, says):
    assert Checker(SCHEMAS).check(parse(text)).startswith(says)


def test_prefix_notation():
    assert prefix.parse("+ ([a], / ([b],int[3]))") == Binary("+", Attr("", "a"), Binary("/", Attr("", "b"), Literal(3, Kind.INT)))
    assert prefix.parse("! (== ([a], string[x y]))") == Unary("!", Binary("==", Attr("", "a"), Literal("x y", Kind.STRING)))
    assert prefix.parse("um (double[-1.5])") == Unary("um", Literal(-1.5, Kind.DOUBLE))
    assert prefix.parse("|| (bool[true], bool[false])") == Binary("||", Literal(True, Kind.BOOL), Literal(False, Kind.BOOL))
    for bad in ("", "+ ([a])", "[a] [b]", "int[x]", "? ([a])"):
        with pytest.raises(ValueError):
            prefix.parse(bad)


def test_estimates():
    query = parse('select a.x from t as a, u as b where (a.x = 1) and (a.y < 5) and (a.x = b.x) and (b.y = 1 or b.y = 2)')
    stats = {"a": Statistics(900, {"x": 10, "y": 50}), "b": Statistics(100, {"x": 10, "y": 4})}
    assert scan_rows(query, stats) == pytest.approx({"a": 30.0, "b": 43.75})
    assert selectivity(query.where[2], stats) == pytest.approx(0.1)
    assert plan_cost(query, stats) == pytest.approx(30 + 43.75 + 30 * 43.75 / 10)
    assert selectivity(where("a.q <> 3")[0], {"a": Statistics(0)}) == 0


def frames(spark):
    return {
        "t": spark.createDataFrame([(1, 2.5, "x", True), (2, -1.25, "y", False), (7, 2.5, "x", True)], "i int, d double, s string, b boolean"),
        "u": spark.createDataFrame([(2, "p"), (3, "q"), (9, "r")], "k int, v string"),
    }


def rows(engine, text):
    return sorted(tuple(r) for r in engine.sql(text).collect())


def test_typed_semantics(spark):
    e = Engine(spark, frames=frames(spark))
    assert rows(e, 'select a.i / 2, "n " + a.s from t as a where a.d > 0') == [(0, "n x"), (3, "n x")]
    assert rows(e, "select avg(a.i), sum(a.i), avg(a.d) from t as a") == [(3, 10, 1.25)]
    assert rows(e, "select sum(a.i) from t as a where a.i > 100") == []
    assert rows(e, "select a.s, sum(1) from t as a group by a.s") == [("x", 2), ("y", 1)]
    assert rows(e, "select a.i, b.v from t as a, u as b where a.i < b.k and not b.k = 9") == [(1, "p"), (1, "q"), (2, "q")]
    assert len(rows(e, "select a.i, b.v from t as a, u as b")) == 9
    assert rows(e, "select a.i from t as a where a.i <> 2 and 1 = 1") == [(1,), (7,)]
    assert rows(e, 'select "k" + a.s, sum(a.i) from t as a where a.i > 0 group by "k" + a.s') == [("kx", 8), ("ky", 2)]


def test_division_by_zero_is_an_error(spark):
    e = Engine(spark, frames=frames(spark))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        e.sql("select a.i / 0 from t as a").collect()


def test_connected_tables_join_without_a_cross_product(spark):
    e = Engine(spark, frames={**frames(spark), "w": spark.createDataFrame([(1, 2)], "a int, b int")})
    plan = e.sql("select x.i from t as x, u as y, w as z where x.i = z.a and z.b = y.k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Inner" in plan and "Cross" not in plan


def test_join_trees_begin_at_filtered_tables():
    """Two chains to one filtered table each are joined apart, then with each other."""
    text = "select p.x from part as p, line as l1, line as l2, cust as c1, cust as c2 where (l1.p = l2.p) and (l1.c = c1.k) and (l2.c = c2.k) and (c1.n = 1) and (c2.n = 2) and (p.k = l2.p)"
    stats = {"p": Statistics(1000, {"k": 1000}), **{f"l{i}": Statistics(100_000, {"p": 1000, "c": 500}) for i in (1, 2)}, **{f"c{i}": Statistics(500, {"k": 500, "n": 500}) for i in (1, 2)}}
    best = Planner(parse(text), stats).best()

    def rows_of(tree):
        return {tree} if isinstance(tree, str) else rows_of(tree[0]) | rows_of(tree[1])

    def parts(tree):
        return [] if isinstance(tree, str) else [frozenset(rows_of(tree)), *parts(tree[0]), *parts(tree[1])]

    assert {frozenset({"l1", "c1"}), frozenset({"l2", "c2"})} <= set(parts(best.tree))
    assert best.cost < 250_000
    greedy = Planner(parse(text), stats)
    assert rows_of(greedy._greedy(greedy.leaves).tree) == rows_of(best.tree) == {"p", "l1", "l2", "c1", "c2"}


def test_products_only_where_nothing_connects():
    text = "select a.x from t as a, t as b, t as c, t as d where (a.x = b.x) and (c.x = d.x)"
    best = Planner(parse(text), {a: Statistics(10.0) for a in "abcd"}).best()
    assert {frozenset(x) for x in best.tree} == {frozenset("ab"), frozenset("cd")}


def test_tables_that_only_multiply(spark):
    """Tables that nothing connects and nothing names are counted, not joined."""
    e = Engine(spark, frames={**frames(spark), "none": spark.createDataFrame([], "x int")})
    assert rows(e, "select a.s, sum(a.i), avg(a.i), sum(1) from t as a, u as b group by a.s") == [("x", 24, 4, 6), ("y", 6, 2, 3)]
    assert rows(e, "select a.s, sum(a.i) from t as a, u as b, u as c where b.k = c.k and b.k > 2 group by a.s") == [("x", 16), ("y", 4)]
    assert rows(e, "select sum(1) from t as a, u as b") == [(9,)]
    assert rows(e, "select a.s from t as a, u as b group by a.s") == [("x",), ("y",)]
    assert rows(e, "select a.s, sum(1) from t as a, none as b group by a.s") == []
    assert rows(e, "select sum(1) from t as a, none as b") == []
    assert rows(e, "select a.s, sum(1) from t as a, u as b where 1 = 2 group by a.s") == []
    plan = e.sql("select a.s, sum(1) from t as a, u as b group by a.s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_literal_zero_is_refused_before_planning(spark):
    e = Engine(spark, frames=frames(spark))
    assert e.check("select a.i / 0 from t as a").startswith("DIVIDE: ")
    assert e.check("select a.d / 0.0 from t as a").startswith("DIVIDE: ")
    assert e.check("select a.i / a.i from t as a") == VALID
