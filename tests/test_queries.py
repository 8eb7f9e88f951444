"""Registered queries against brute force over whole tables, read without the queries' own SQL."""

import duckdb
import pytest

from fixlog import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "supplier")


@pytest.fixture(scope="module")
def tables():
    return {t: duckdb.sql(f"SELECT * FROM '{DIR}/{t}.parquet'").df().to_dict("records") for t in TABLES}


@pytest.fixture(scope="module")
def nations(tables):
    nation = {r["c_custkey"]: r["c_nationkey"] for r in tables["customer"]}
    orders = {r["o_orderkey"]: nation[r["o_custkey"]] for r in tables["orders"] if r["o_custkey"] in nation}
    supplier = {r["s_suppkey"]: r["s_nationkey"] for r in tables["supplier"]}
    return {(orders[r["l_orderkey"]], supplier[r["l_suppkey"]]) for r in tables["lineitem"] if r["l_orderkey"] in orders and r["l_suppkey"] in supplier}


@pytest.fixture(scope="module")
def edges(tables):
    n = len(tables["customer"])
    return {(r["o_custkey"], (r["o_orderkey"] * 7 + 3) % n) for r in tables["orders"]}


def closed(found, step):
    new = found
    while new:
        new = step(new) - found
        found = found | new
    return found


def by_sql(name):
    """The query's SQL over the same tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return sorted(con.sql(Q.oracle_sql()[name]).fetchall())


def by_spark(spark, name):
    return sorted(tuple(r) for r in Q.queries()[name](spark, DIR).collect())


@pytest.mark.parametrize("name", ["tc_linear", "tc_nonlinear"])
def test_closure_of_all_orders(spark, nations, name):
    want = closed(nations, lambda new: {(x, z) for x, y in new for a, z in nations if a == y})
    assert by_spark(spark, name) == by_sql(name) == sorted(want)


def test_same_generation_of_all_orders(spark, nations):
    seed = {(x, y) for p, x in nations for q, y in nations if p == q}
    below = {}
    for p, x in nations:
        below.setdefault(p, []).append(x)
    want = closed(seed, lambda new: {(x, y) for p, q in new for x in below.get(p, ()) for y in below.get(q, ())})
    assert by_spark(spark, "same_generation") == by_sql("same_generation") == sorted(want)


@pytest.mark.parametrize(("name", "best"), [("cc_weak", min), ("label_max", max)])
def test_components_of_all_edges(spark, tables, edges, name, best):
    label = {r["c_custkey"]: r["c_custkey"] for r in tables["customer"]}
    changed = True
    while changed:
        changed = False
        for x, y in edges:
            b = best(label.get(x, x), label.get(y, y))
            for v in (x, y):
                if label.get(v, v) != b:
                    label[v], changed = b, True
    assert by_spark(spark, name) == by_sql(name) == sorted(label.items())


def test_even_hops_over_all_edges(spark, edges):
    want = closed({(0, 0)}, lambda new: {(y, 1 - k) for x, k in new for a, y in edges if a == x})
    want = sorted((x,) for x, k in want if k == 0)
    assert len(want) > 15
    assert by_spark(spark, "mutual_even_odd") == by_sql("mutual_even_odd") == want
