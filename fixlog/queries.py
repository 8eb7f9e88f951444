"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import programs as P
from .engine import Engine
from .sources import graphs

_EDGES = "SELECT DISTINCT o_custkey AS src, (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) AS dst, 1 + o_orderkey % 100 AS w FROM orders"
#: The graphs in SQL, the same for Spark and DuckDB.
GRAPHS = {
    "vertices": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS label FROM customer",
    "edges": _EDGES,
    "dag": f"SELECT DISTINCT greatest(src, dst) AS src, least(src, dst) AS dst, w FROM ({_EDGES}) g WHERE src <> dst",
    "both_ways": f"SELECT src, dst, w FROM ({_EDGES}) g UNION SELECT dst, src, w FROM ({_EDGES}) h",
    "nations": "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, 1 AS w FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey",
    "gaps": "SELECT DISTINCT nullif(CAST(c_nationkey AS BIGINT), 3) AS src, nullif(CAST(s_nationkey AS BIGINT), 7) AS dst, 1 AS w FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey",
}
#: Tables as relations: the columns taken, in order.
TABLES = {
    "customer": "c_custkey, c_nationkey, c_mktsegment",
    "nation": "n_nationkey, n_name, n_regionkey",
    "region": "r_regionkey, r_name",
    "supplier": "s_suppkey, s_nationkey",
    "orders": "o_orderkey, o_custkey, o_orderstatus",
    "lineitem": "l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_returnflag",
    "part": "p_partkey, p_brand, p_type, p_size",
}
_VIEWS = ("customer", "nation", "region", "supplier", "orders", "lineitem", "part")


def _read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables at ``sf_dir``."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _VIEWS if t in sql}
    return spark.sql(_templated(sql, frames), **frames)


def _templated(sql: str, frames: dict[str, DataFrame]) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) (" + "|".join(_VIEWS) + r")\b", r"\1 {\2}", sql)


@dataclass(frozen=True)
class Query:
    program: str
    out: str
    columns: str
    sql: str
    graph: str = ""
    tables: str = ""
    options: tuple[tuple[str, bool], ...] = ()

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, **dict(self.options))
        if self.graph:
            vertices, edges = (_read(spark, sf_dir, GRAPHS[g]) for g in ("vertices", self.graph))
            engine.register_graph(vertices, edges, distinct=False)  # both are distinct by their definition
        for t in self.tables.split():
            engine.register(t, _read(spark, sf_dir, f"SELECT {TABLES[t]} FROM {t}"), distinct=False)  # keyed tables
        return engine.run(self.program)[self.out].toDF(*self.columns.split())

    def oracle(self) -> str:
        views = [f"{name} AS ({GRAPHS[g]})" for name, g in (("vertices", "vertices"), ("edges", self.graph)) if self.graph]
        sql = self.sql.strip()
        recursive = sql.startswith("RECURSIVE ")
        sql = sql.removeprefix("RECURSIVE ")
        if views:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(views)}"
            return f"{head}, {sql}" if recursive else f"{head} {sql}"
        return f"WITH RECURSIVE {sql}" if recursive else sql


_BEST = "RECURSIVE best(x, d) USING KEY (x) AS (SELECT {seed} UNION {step}) SELECT {out} FROM best"
_L = "CAST(l_linenumber AS BIGINT)"
_REACH_DAG = "RECURSIVE walk(x, c, k) AS (SELECT 30, 1::BIGINT, 0 UNION ALL SELECT e.src, sum(c)::BIGINT, k + 1 FROM walk JOIN edges e ON e.dst = x GROUP BY e.src, k + 1) SELECT x, sum(c)::BIGINT AS n FROM walk GROUP BY x"
_PR = "RECURSIVE pr(x, i, p) AS (SELECT id, 0::BIGINT, id FROM vertices UNION ALL SELECT e.dst, i + 1, sum({value})::BIGINT FROM pr JOIN edges e ON e.src = x {more} WHERE i < 10 GROUP BY e.dst, i + 1) SELECT x, i, p FROM pr"

QUERIES: dict[str, Query] = {
    # scans, filters, projections
    "scan_project": Query("p(X,N):-vertices(X,N);", "p", "x n", "SELECT id AS x, label AS n FROM vertices", "edges"),
    "filter_eq": Query("p(X):-vertices(X,N),N==7;", "p", "x", "SELECT id AS x FROM vertices WHERE label = 7", "edges"),
    "filter_neq": Query('p(X,S):-orders(X,_,S),S!="O";', "p", "x s", "SELECT o_orderkey AS x, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'O'", tables="orders"),
    "filter_lt": Query("p(X,Y,E):-edges(X,Y,E),E<5;", "p", "x y e", "SELECT src AS x, dst AS y, w AS e FROM edges WHERE w < 5", "edges"),
    "filter_gt": Query("p(X,Y):-edges(X,Y,E),E>95;", "p", "x y", "SELECT DISTINCT src AS x, dst AS y FROM edges WHERE w > 95", "edges"),
    "filter_le": Query("p(X,Y):-edges(X,Y,E),E<=3;", "p", "x y", "SELECT DISTINCT src AS x, dst AS y FROM edges WHERE w <= 3", "edges"),
    "filter_ge": Query("p(X,Y):-edges(X,Y,E),E>=99;", "p", "x y", "SELECT DISTINCT src AS x, dst AS y FROM edges WHERE w >= 99", "edges"),
    "filter_and_or": Query("p(X):-vertices(X,N),(N<3||N>20)&&X!=7;", "p", "x", "SELECT id AS x FROM vertices WHERE (label < 3 OR label > 20) AND id <> 7", "edges"),
    "comments": Query("% the whole line\np(X, N) :- % the rest of one\n  vertices(X, N), N > 20;\n% and at the end", "p", "x n", "SELECT id AS x, label AS n FROM vertices WHERE label > 20", "edges"),
    "const_in_atom": Query('p(X,Y):-edges(X,Y,5);p(X,C):-orders(X,C,"F"),X<50;', "p", "x y", "SELECT src AS x, dst AS y FROM edges WHERE w = 5 UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey < 50", "edges", "orders"),
    "constant_condition": Query("p(X):-vertices(X,N),1==2;p(X):-vertices(X,3),2>1;", "p", "x", "SELECT id AS x FROM vertices WHERE label = 3", "edges"),
    "repeated_var": Query("p(X,E):-edges(X,X,E);", "p", "x e", "SELECT src AS x, w AS e FROM edges WHERE src = dst", "edges"),
    "wildcard_prefix_atom": Query("p(X):-edges(X,_);", "p", "x", "SELECT DISTINCT src AS x FROM edges", "edges"),
    "neighbour_views": Query("p(X,Y,W):-outgoingNeighbors(X,Y,W),incomingNeighbors(Y,X,W),W<20;", "p", "x y w", "SELECT src AS x, dst AS y, w FROM edges WHERE w < 20", "edges"),
    "arith_head": Query("p(X,X*2+N-1,(X+N)*(X-N)):-vertices(X,N);", "p", "x a b", "SELECT id AS x, id * 2 + label - 1 AS a, (id + label) * (id - label) AS b FROM vertices", "edges"),
    "int_div": Query("p(X,INT(X/7),INT(X/(N-N))):-vertices(X,N);", "p", "x a b", "SELECT id AS x, id // 7 AS a, 0::BIGINT AS b FROM vertices", "edges"),
    "unary_minus": Query("p(X,-X):-vertices(X,N),-N>-3;", "p", "x a", "SELECT id AS x, -id AS a FROM vertices WHERE label < 3", "edges"),
    "const_head": Query('p(X,1,"one"):-vertices(X,1);', "p", "x a b", "SELECT id AS x, 1::BIGINT AS a, 'one' AS b FROM vertices WHERE label = 1", "edges"),
    "facts": Query('q(1,"a");q(2,"b");q(3,"c"):-1==1;p(X,S):-vertices(X,N),q(N,S);', "p", "x s", "SELECT id AS x, CASE label WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS s FROM vertices WHERE label BETWEEN 1 AND 3", "edges"),
    "set_dedupe": Query("p(N):-vertices(X,N);", "p", "n", "SELECT DISTINCT label AS n FROM vertices", "edges"),
    "union_rules": Query("p(X):-edges(X,_,1);p(Y):-edges(_,Y,2);p(X):-vertices(X,4);", "p", "x", "SELECT src AS x FROM edges WHERE w = 1 UNION SELECT dst FROM edges WHERE w = 2 UNION SELECT id FROM vertices WHERE label = 4", "edges"),
    "intersect_atoms": Query("a(X):-edges(X,_,E),E<30;b(X):-edges(_,X,E),E<30;p(X):-a(X),b(X);", "p", "x", "SELECT src AS x FROM edges WHERE w < 30 INTERSECT SELECT dst FROM edges WHERE w < 30", "edges"),
    "negation": Query("p(X):-vertices(X,_),not edges(X,_,1);", "p", "x", "SELECT id AS x FROM vertices WHERE id NOT IN (SELECT src FROM edges WHERE w = 1)", "edges"),
    # joins
    "join_equi": Query("p(O,N):-orders(O,C,_),customer(C,N,_);", "p", "o n", "SELECT o_orderkey AS o, c_nationkey::BIGINT AS n FROM orders JOIN customer ON c_custkey = o_custkey", tables="orders customer"),
    "join_multiway": Query('p(N,R,L,Q):-region(K,R),nation(A,N,K),customer(C,A,"BUILDING"),orders(O,C,_),lineitem(O,L,_,_,Q,_),Q>45;', "p", "n r l q", "SELECT DISTINCT n_name AS n, r_name AS r, l_linenumber::BIGINT AS l, l_quantity::BIGINT AS q FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND l_quantity > 45", tables="region nation customer orders lineitem"),
    "join_self": Query("p(X,Z):-edges(X,Y,A),edges(Y,Z,B),A<20,B<20;", "p", "x z", "SELECT DISTINCT a.src AS x, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src WHERE a.w < 20 AND b.w < 20", "edges"),
    "join_theta": Query("p(A,B):-region(A,_),nation(B,_,_),A*6<B;", "p", "a b", "SELECT r_regionkey::BIGINT AS a, n_nationkey::BIGINT AS b FROM region JOIN nation ON r_regionkey * 6 < n_nationkey", tables="region nation"),
    "join_computed_key": Query("p(X,Y):-vertices(X,N),vertices(Y,M),Y==X+1,N!=M;", "p", "x y", "SELECT a.id AS x, b.id AS y FROM vertices a JOIN vertices b ON b.id = a.id + 1 WHERE a.label <> b.label", "edges"),
    "join_expression_in_atom": Query("p(X,N):-vertices(X,N),vertices(X+2,N);", "p", "x n", "SELECT a.id AS x, a.label AS n FROM vertices a JOIN vertices b ON b.id = a.id + 2 AND a.label = b.label", "edges"),
    "join_residual": Query("p(X,Y):-edges(X,Y,E),vertices(X,N),vertices(Y,M),N+M>E,N<M;", "p", "x y", "SELECT DISTINCT src AS x, dst AS y FROM edges JOIN vertices a ON a.id = src JOIN vertices b ON b.id = dst WHERE a.label + b.label > w AND a.label < b.label", "edges"),
    "cross_join": Query("p(A,B):-region(A,_),nation(B,_,_);", "p", "a b", "SELECT r_regionkey::BIGINT AS a, n_nationkey::BIGINT AS b FROM region, nation", tables="region nation"),
    "triangles": Query("t(COUNT(X)):-edges(X,Y,_),edges(Y,Z,_),edges(Z,X,_),X<Y,X<Z;", "t", "n", "SELECT count(*) AS n FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst", "edges"),
    "semi_join": Query("p(C):-customer(C,_,_),orders(_,C,_);", "p", "c", "SELECT DISTINCT o_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey", tables="customer orders"),
    # aggregates
    "agg_sum": Query("p(X,SUM(E)):-edges(X,_,E);", "p", "x s", "SELECT src AS x, sum(w)::BIGINT AS s FROM edges GROUP BY src", "edges"),
    "agg_count": Query("p(F,COUNT(O)):-lineitem(O,_,_,_,_,F);", "p", "f n", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1", tables="lineitem"),
    "agg_min": Query("p(X,MIN(E)):-edges(_,X,E);", "p", "x m", "SELECT dst AS x, min(w) AS m FROM edges GROUP BY dst", "edges"),
    "agg_max": Query("p(X,MAX(E)):-edges(_,X,E);", "p", "x m", "SELECT dst AS x, max(w) AS m FROM edges GROUP BY dst", "edges"),
    "agg_global": Query("p(SUM(Q)):-lineitem(_,_,_,_,Q,_);", "p", "s", "SELECT sum(l_quantity::BIGINT)::BIGINT AS s FROM lineitem", tables="lineitem"),
    "agg_empty": Query("p(COUNT(X)):-vertices(X,N),N<0;", "p", "n", "SELECT 0::BIGINT AS n WHERE false", "edges"),
    "agg_expr": Query("p(N,SUM(E*2+N)):-edges(X,_,E),vertices(X,N);", "p", "n s", "SELECT label AS n, sum(w * 2 + label)::BIGINT AS s FROM edges JOIN vertices ON id = src GROUP BY label", "edges"),
    "agg_multi_group": Query("p(F,L,SUM(Q)):-lineitem(_,L,_,_,Q,F);", "p", "f l s", f"SELECT l_returnflag AS f, {_L} AS l, sum(l_quantity::BIGINT)::BIGINT AS s FROM lineitem GROUP BY 1, 2", tables="lineitem"),
    "agg_join_bag": Query("p(N,COUNT(Y)):-vertices(X,N),edges(X,Y);", "p", "n c", "SELECT label AS n, count(*) AS c FROM vertices JOIN edges ON src = id GROUP BY label", "edges"),
    "agg_union_rules": Query("p(X,SUM(E)):-edges(X,_,E);p(X,SUM(E)):-edges(_,X,E);p(X,1):-vertices(X,_);", "p", "x s", "SELECT x, sum(v)::BIGINT AS s FROM (SELECT src AS x, w AS v FROM edges UNION ALL SELECT dst, w FROM edges UNION ALL SELECT id, 1 FROM vertices) u GROUP BY x", "edges"),
    "having_via_rule": Query("d(X,COUNT(Y)):-edges(X,Y);p(X,C):-d(X,C),C>12;", "p", "x c", "SELECT src AS x, count(*) AS c FROM edges GROUP BY src HAVING count(*) > 12", "edges"),
    "avg_via_rules": Query("s(X,SUM(E)):-edges(X,_,E);n(X,COUNT(E)):-edges(X,_,E);p(X,INT(100*S/N)):-s(X,S),n(X,N);", "p", "x a", "SELECT src AS x, trunc(100 * sum(w) / count(*))::BIGINT AS a FROM edges GROUP BY src", "edges"),
    "degree_in": Query("p(X,COUNT(Y)):-edges(Y,X);", "p", "x n", "SELECT dst AS x, count(*) AS n FROM edges GROUP BY dst", "edges"),
    "degree_out": Query("p(X,COUNT(Y)):-edges(X,Y);", "p", "x n", "SELECT src AS x, count(*) AS n FROM edges GROUP BY src", "edges"),
    "edges_by_region": Query("p(R,S,SUM(E)):-edges(X,Y,E),vertices(X,A),vertices(Y,B),nation(A,_,K),nation(B,_,L),region(K,R),region(L,S);", "p", "r s e", "SELECT a.r_name AS r, b.r_name AS s, sum(w)::BIGINT AS e FROM edges JOIN vertices x ON x.id = src JOIN vertices y ON y.id = dst JOIN nation m ON m.n_nationkey = x.label JOIN nation n ON n.n_nationkey = y.label JOIN region a ON a.r_regionkey = m.n_regionkey JOIN region b ON b.r_regionkey = n.n_regionkey GROUP BY 1, 2", "edges", "nation region"),
    # recursion: sets
    "reach": Query("r(X):-vertices(X,_),X==1;r(Y):-r(X),edges(X,Y,E),E<40;", "r", "x", "RECURSIVE r(x) AS (SELECT 1::BIGINT UNION SELECT dst FROM r JOIN edges ON src = x WHERE w < 40) SELECT x FROM r", "edges"),
    "tc_linear": Query("t(X,Y):-edges(X,Y);t(X,Z):-t(X,Y),edges(Y,Z);", "t", "x y", "RECURSIVE t(x, y) AS (SELECT src, dst FROM edges UNION SELECT x, dst FROM t JOIN edges ON src = y) SELECT x, y FROM t", "nations"),
    "tc_nonlinear": Query("t(X,Y):-edges(X,Y);t(X,Z):-t(X,Y),t(Y,Z);", "t", "x y", "RECURSIVE t(x, y) AS (SELECT src, dst FROM edges UNION SELECT x, dst FROM t JOIN edges ON src = y) SELECT x, y FROM t", "nations"),
    "tc_nulls": Query("t(X,Y):-edges(X,Y);t(X,Z):-t(X,Y),edges(Y,Z);", "t", "x y", "RECURSIVE t(x, y) AS (SELECT src, dst FROM edges UNION SELECT x, dst FROM t JOIN edges ON src = y) SELECT x, y FROM t", "gaps"),
    "mutual_even_odd": Query("even(X):-vertices(X,_),X==0;odd(Y):-even(X),edges(X,Y);even(Y):-odd(X),edges(X,Y);", "even", "x", "RECURSIVE h(x, k) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, 1 - k FROM h JOIN edges ON src = x) SELECT x FROM h WHERE k = 0", "edges"),
    "same_generation": Query("s(X,Y):-edges(P,X),edges(P,Y);s(X,Y):-edges(P,X),s(P,Q),edges(Q,Y);", "s", "x y", "RECURSIVE s(x, y) AS (SELECT a.dst, b.dst FROM edges a JOIN edges b ON a.src = b.src UNION SELECT a.dst, b.dst FROM s JOIN edges a ON a.src = x JOIN edges b ON b.src = y) SELECT x, y FROM s", "nations"),
    # recursion: MIN and MAX
    "cc_min": Query(P.CONNECTED_COMPONENTS, "l", "x l", _BEST.format(seed="id, id FROM vertices", step="SELECT src, c.d FROM (SELECT e.src, min(b.d) AS d FROM edges e JOIN best b ON b.x = e.dst GROUP BY e.src) c JOIN recurring.best o ON o.x = c.src WHERE c.d < o.d", out="x, d AS l"), "edges"),
    "cc_weak": Query(P.CONNECTED_COMPONENTS, "l", "x l", _BEST.format(seed="id, id FROM vertices", step="SELECT src, c.d FROM (SELECT e.src, min(b.d) AS d FROM edges e JOIN best b ON b.x = e.dst GROUP BY e.src) c JOIN recurring.best o ON o.x = c.src WHERE c.d < o.d", out="x, d AS l"), "both_ways"),
    "sssp_hops": Query(P.HOPS_FROM_SOURCE, "path", "x d", "RECURSIVE h(x, d) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT dst, d + 1 FROM h JOIN edges ON src = x WHERE d < 12) SELECT x, min(d) AS d FROM h GROUP BY x", "edges"),
    "sssp_weighted": Query(P.SHORTEST_PATH, "path", "x z d", _BEST.format(seed="66::BIGINT, 0::BIGINT", step="SELECT src, c.d FROM (SELECT e.src, min(b.d + e.w) AS d FROM edges e JOIN best b ON b.x = e.dst GROUP BY e.src) c LEFT JOIN recurring.best o ON o.x = c.src WHERE o.x IS NULL OR c.d < o.d", out="x, 66::BIGINT AS z, d"), "edges"),
    "sssp_mutual": Query(P.SHORTEST_PATH_MUTUAL, "shortest_path", "x z d", _BEST.format(seed="66::BIGINT, 0::BIGINT", step="SELECT src, c.d FROM (SELECT e.src, min(b.d + e.w) AS d FROM edges e JOIN best b ON b.x = e.dst GROUP BY e.src) c LEFT JOIN recurring.best o ON o.x = c.src WHERE o.x IS NULL OR c.d < o.d", out="x, 66::BIGINT AS z, d"), "edges"),
    "label_max": Query("m(X,X):-vertices(X,_);m(X,MAX(L)):-edges(X,Y),m(Y,L);", "m", "x l", _BEST.format(seed="id, id FROM vertices", step="SELECT src, c.d FROM (SELECT e.src, max(b.d) AS d FROM edges e JOIN best b ON b.x = e.dst GROUP BY e.src) c JOIN recurring.best o ON o.x = c.src WHERE c.d > o.d", out="x, d AS l"), "both_ways"),
    # recursion: SUM and COUNT
    "pathcount_dag": Query(P.PATHCOUNT, "pathcount", "x n", _REACH_DAG, "dag"),
    "walk_count_bounded": Query("w(X,0,1):-vertices(X,_),X==1;w(Y,I+1,COUNT(P)):-w(X,I,P),edges(X,Y),I<4;", "w", "x i n", "RECURSIVE w(x, i, n) AS (SELECT 1::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT dst, i + 1, count(*) FROM w JOIN edges ON src = x WHERE i < 4 GROUP BY dst, i + 1) SELECT x, i, n FROM w", "edges"),
    "pagerank_toy": Query(P.PAGERANK, "pagerank", "x i p", _PR.format(value="p + label", more="JOIN vertices v ON v.id = x"), "edges"),
    "pagerank_old": Query(P.PAGERANK_OLD, "pagerank", "x i p", _PR.format(value="p", more="JOIN (SELECT DISTINCT src AS o FROM edges) d ON d.o = x"), "edges"),
    "downstream_stratum": Query(P.HOPS_FROM_SOURCE + "p(D,COUNT(X)):-path(X,D);far(X):-path(X,D),D>3;q(D,N,C):-p(D,N),c(C);c(COUNT(X)):-far(X);", "q", "d n far", "RECURSIVE h(x, d) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT dst, d + 1 FROM h JOIN edges ON src = x WHERE d < 12), m AS (SELECT x, min(d) AS d FROM h GROUP BY x) SELECT d, count(*) AS n, (SELECT count(*) FROM m WHERE d > 3) AS far FROM m GROUP BY d", "edges"),
    # functions
    "udf_int": Query("p(X,INT(X/3),INT((0-X)/3)):-vertices(X,_);", "p", "x a b", "SELECT id AS x, trunc(id / 3)::BIGINT AS a, trunc(-id / 3)::BIGINT AS b FROM vertices", "edges"),
    "udf_mode": Query("p(A,B,Mode(A,B)):-lineitem(_,A,_,_,B,_);", "p", "a b m", f"SELECT DISTINCT {_L} AS a, l_quantity::BIGINT AS b, CASE WHEN l_linenumber > l_quantity::BIGINT THEN 'A' ELSE 'B' END AS m FROM lineitem", tables="lineitem"),
    "udf_ap_classify": Query("p(A,B,AP_CLASSIFY(A,B,1)):-lineitem(_,A,_,_,B,_);", "p", "a b m", f"SELECT DISTINCT {_L} AS a, l_quantity::BIGINT AS b, CASE WHEN l_linenumber >= l_quantity::BIGINT THEN 'DB' ELSE 'ML' END AS m FROM lineitem", tables="lineitem"),
    "udf_ap_confidence": Query("p(A,B,AP_CONFIDENCE(A,B,1)):-lineitem(_,A,_,_,B,_);", "p", "a b m", f"SELECT DISTINCT {_L} AS a, l_quantity::BIGINT AS b, (100 * greatest(l_linenumber, l_quantity::BIGINT) // (2 * l_linenumber + l_quantity::BIGINT))::BIGINT AS m FROM lineitem", tables="lineitem"),
    "udf_er_classify": Query("p(A,B,ER_CLASSIFY(A,B)):-lineitem(_,_,_,A,B,_);", "p", "a b m", "SELECT DISTINCT l_suppkey AS a, l_quantity::BIGINT AS b, CASE WHEN l_suppkey > 10 AND l_quantity::BIGINT > 50 THEN 1 ELSE 0 END::BIGINT AS m FROM lineitem", tables="lineitem"),
    "udf_er_confidence": Query("p(A,B,ER_CONFIDENCE(A,B)):-lineitem(_,A,_,_,B,_);", "p", "a b m", f"SELECT DISTINCT {_L} AS a, l_quantity::BIGINT AS b, ({_L} + l_quantity::BIGINT) // 2 AS m FROM lineitem", tables="lineitem"),
    "udf_confidence": Query("p(A,B,Confidence(A,B)):-lineitem(_,A,_,_,B,_);", "p", "a b m", f"SELECT DISTINCT {_L} AS a, l_quantity::BIGINT AS b, (100 * greatest({_L}, l_quantity::BIGINT)) // ({_L} + l_quantity::BIGINT) AS m FROM lineitem", tables="lineitem"),
    "udf_labelmatch": Query("p(X,Y,LabelMatch(N,M)):-edges(X,Y,1),vertices(X,N),vertices(Y,M);", "p", "x y m", "SELECT DISTINCT src AS x, dst AS y, (a.label = b.label)::BIGINT AS m FROM edges JOIN vertices a ON a.id = src JOIN vertices b ON b.id = dst WHERE w = 1", "edges"),
    "udf_match": Query("p(A,B,Match(SHINGLE(A,6),SHINGLE(B,6))):-customer(_,_,A),customer(_,_,B);", "p", "a b m", "WITH s AS (SELECT DISTINCT c_mktsegment AS a, rpad(array_to_string(list_sort(list_distinct(string_split(c_mktsegment, '')))[1:6], ''), 6, chr(0)) AS k FROM customer) SELECT x.a, y.a AS b, list_sum(list_transform(range(1, 7), lambda i: (x.k[i] = y.k[i])::BIGINT))::BIGINT * 1000 // 6 AS m FROM s x, s y", tables="customer"),
    "udf_str_sim": Query("p(A,B,STR_SIM(A,B)):-customer(_,_,A),part(_,_,B,_);", "p", "a b m", "SELECT a, b, CASE WHEN a = b OR regexp_matches(a, '[0-9]$') OR regexp_matches(b, '[0-9]$') THEN 0 ELSE (greatest(len(a), len(b)) - levenshtein(a, b)) * 100 // greatest(len(a), len(b)) END::BIGINT AS m FROM (SELECT DISTINCT c_mktsegment AS a FROM customer) x, (SELECT DISTINCT p_type AS b FROM part) y", tables="customer part"),
    "udf_shingle": Query("p(A,SHINGLE(A,4)):-part(_,_,A,_);", "p", "a m", "SELECT DISTINCT p_type AS a, rpad(array_to_string(list_sort(list_distinct(string_split(p_type, '')))[1:4], ''), 4, chr(0)) AS m FROM part", tables="part"),
    # the same by other plans
    "eager_off": Query("p(N,SUM(E)):-edges(X,_,E),vertices(X,N);", "p", "n s", "SELECT label AS n, sum(w)::BIGINT AS s FROM edges JOIN vertices ON id = src GROUP BY label", "edges", options=(("eager_aggregation", False),)),
    "eager_on": Query("p(N,SUM(E)):-edges(X,_,E),vertices(X,N);", "p", "n s", "SELECT label AS n, sum(w)::BIGINT AS s FROM edges JOIN vertices ON id = src GROUP BY label", "edges"),
    "semi_join_off": Query("p(C):-customer(C,_,_),orders(_,C,_);", "p", "c", "SELECT DISTINCT o_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey", tables="customer orders", options=(("semi_join", False),)),
}


def edge_list_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made dense, orientation and both directions, without random parts."""
    lines = _read(spark, sf_dir, f"SELECT concat(src * 10 + 7, chr(9), dst * 10 + 7) AS value FROM ({_EDGES}) g")
    imported = graphs.import_edges(graphs.edge_lines(lines), orientation="dag")
    return imported.edges.select("src", "dst", "w")


def graph_json_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as JSON lines and read again."""
    lines = graphs.to_json_lines(_read(spark, sf_dir, GRAPHS["vertices"]), _read(spark, sf_dir, GRAPHS["edges"]), super_vertices=64)
    return graphs.from_json_lines(lines).edges


def mixed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges sent down where the ids' bitwise XOR is odd, else up."""
    return graphs.import_edges(_read(spark, sf_dir, _EDGES), orientation="mixed").edges.select("src", "dst", "w")


def graph_side_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.side_lines(_read(spark, sf_dir, GRAPHS["vertices"]), _read(spark, sf_dir, GRAPHS["edges"]))


def own_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered function, with the type it was given."""
    engine = Engine(spark).register("orders", _read(spark, sf_dir, f"SELECT {TABLES['orders']} FROM orders"), distinct=False)
    engine.register_udf("Tag", lambda s, k: F.concat(s, F.lit("-"), k % 3), 2, "string")
    return engine.run("p(X,Tag(S,X)):-orders(X,_,S);")["p"].toDF("x", "t")


def relation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each relation of a program has."""
    engine = Engine(spark).register("orders", _read(spark, sf_dir, f"SELECT {TABLES['orders']} FROM orders"), distinct=False)
    sizes = engine.run('p(C):-orders(_,C,_);q(X):-orders(X,_,"F");').sizes()
    return spark.createDataFrame(sorted(sizes.items()), "name string, n long")


def edge_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _read(spark, sf_dir, GRAPHS["edges"])
    return graphs.partition_quality(edges, 16)


IMPORTS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "edge_list_import": (edge_list_import, f"WITH g AS ({_EDGES}), ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM g UNION SELECT dst FROM g)), p AS (SELECT DISTINCT a.k AS x, b.k AS y FROM g JOIN ids a ON a.id = src JOIN ids b ON b.id = dst WHERE a.k <> b.k) SELECT DISTINCT greatest(x, y) AS src, least(x, y) AS dst, 1::BIGINT AS w FROM p"),
    "graph_json_load": (graph_json_load, GRAPHS["edges"]),
    "mixed_import": (mixed_import, f"WITH g AS ({_EDGES}), ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM g UNION SELECT dst FROM g)), p AS (SELECT DISTINCT greatest(a.k, b.k) AS hi, least(a.k, b.k) AS lo FROM g JOIN ids a ON a.id = src JOIN ids b ON b.id = dst WHERE a.k <> b.k) SELECT CASE WHEN xor(hi, lo) % 2 = 1 THEN hi ELSE lo END AS src, CASE WHEN xor(hi, lo) % 2 = 1 THEN lo ELSE hi END AS dst, 1::BIGINT AS w FROM p"),
    "graph_side_lines": (graph_side_lines, f"WITH g AS ({_EDGES}), o AS (SELECT src, string_agg(concat('edge', chr(9), src, chr(9), dst, chr(9), w, chr(9)), '' ORDER BY dst, w) AS rest FROM g GROUP BY src) SELECT concat('vertex', chr(9), id, chr(9), label, chr(9), coalesce(rest, '')) AS value FROM ({GRAPHS['vertices']}) v LEFT JOIN o ON src = id"),
    "own_function": (own_function, "SELECT o_orderkey AS x, concat(o_orderstatus, '-', o_orderkey % 3) AS t FROM orders"),
    "relation_sizes": (relation_sizes, "SELECT 'p' AS name, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'q', count(*) FROM orders WHERE o_orderstatus = 'F'"),
    "edge_cut": (edge_cut, f"WITH g AS ({_EDGES}) SELECT (SELECT count(*) FROM g WHERE src % 16 <> dst % 16) AS edge_cut, (SELECT count(*) FROM (SELECT DISTINCT src, dst % 16 FROM g WHERE src % 16 <> dst % 16)) AS communication_volume"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, **{k: f for k, (f, _) in IMPORTS.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: q.oracle() for k, q in QUERIES.items()}, **{k: sql for k, (_, sql) in IMPORTS.items()}}
