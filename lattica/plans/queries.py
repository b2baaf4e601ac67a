"""Registered queries of the graph engine, with DuckDB SQL for all that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import predicates as P
from lattica.model import Graph
from lattica.operators import components as C
from lattica.operators import distances as D
from lattica.operators import llp as L
from lattica.operators import rank as R
from lattica.operators import stats as S
from lattica.operators import transform as T
from lattica.operators import visits as V
from lattica.plans import views
from lattica.sources import arcs as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ORDERS, EVENTS, PARTS, TREE = views.ORDERS_SQL, views.EVENTS_SQL, views.PARTS_SQL, views.TREE_SQL


def query(name: str, sql: str | None = None, view: str | None = None) -> Callable:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            head = f"WITH RECURSIVE {view}" if view else ""
            SQL[name] = f"{head}{',' if view and sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return f

    return add


def _orders(s, d) -> Graph:
    return views.orders_graph(s, d)


def _reversal(g: Graph) -> DataFrame:
    return g.nodes.select("id", (F.lit(g.n - 1) - F.col("id")).alias("new_id"))


DISTRIBUTION = """SELECT degree, coalesce(nodes, 0) AS nodes FROM (SELECT unnest(range((SELECT max(d) + 1 FROM deg))) AS degree) r
LEFT JOIN (SELECT d, count(*) AS nodes FROM deg GROUP BY d) c ON c.d = r.degree"""


@query("degree_distribution", f"+ deg AS (SELECT id, count(src) AS d FROM v LEFT JOIN g ON src = id GROUP BY id) {DISTRIBUTION}", ORDERS)
def degree_distribution(s, d):
    return S.distribution(S.outdegrees(_orders(s, d)))


@query("indegree_distribution", f"+ deg AS (SELECT id, count(dst) AS d FROM v LEFT JOIN g ON dst = id GROUP BY id) {DISTRIBUTION}", PARTS)
def indegree_distribution(s, d):
    return S.distribution(S.indegrees(views.parts_graph(s, d)[0]))


@query("transpose", "SELECT dst AS src, src AS dst FROM g", ORDERS)
def transpose(s, d):
    return T.transpose(_orders(s, d)).arcs


@query("symmetrize", "SELECT src, dst FROM g UNION SELECT dst, src FROM g", EVENTS)
def symmetrize(s, d):
    return T.symmetrize(views.events_graph(s, d)).arcs


@query("symmetrize_simple", "SELECT src, dst FROM g WHERE src <> dst UNION SELECT dst, src FROM g WHERE src <> dst", EVENTS)
def symmetrize_simple(s, d):
    return T.symmetrize(views.events_graph(s, d), loops=False).arcs


@query("without_loops", "SELECT src, dst FROM g WHERE src <> dst", EVENTS)
def without_loops(s, d):
    return T.without_loops(views.events_graph(s, d)).arcs


@query("permute", "SELECT (SELECT count(*) FROM v) - 1 - src AS src, (SELECT count(*) FROM v) - 1 - dst AS dst FROM g", ORDERS)
def permute(s, d):
    g = _orders(s, d)
    return T.permute(g, _reversal(g)).arcs


@query("map_nodes", "SELECT DISTINCT src // 10 AS src, dst // 10 AS dst FROM g", EVENTS)
def map_nodes(s, d):
    g = views.events_graph(s, d)
    return T.map_nodes(g, g.nodes.select("id", F.floor(F.col("id") / 10).cast("long").alias("new_id"))).arcs


@query("union", "SELECT src, dst FROM g UNION SELECT user_id, nxt FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL", ORDERS)
def union(s, d):
    return T.union(_orders(s, d), views.events_graph(s, d)).arcs


@query("labelled_union_zip", """+ p AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM g),
t AS (SELECT dst AS src, src AS dst, row_number() OVER (PARTITION BY dst ORDER BY src) AS pos FROM g)
SELECT p.src, p.dst, t.dst AS other FROM p JOIN t ON p.src = t.src AND p.pos = t.pos""", ORDERS)  # fmt: skip
def zipped(s, d):
    g = _orders(s, d)
    return T.project(T.zip_labels(g, T.transpose(g)), "right").arcs.withColumnRenamed("label", "other")


@query("dedup_labels", "SELECT l_partkey AS src, l_suppkey AS dst, min(l_quantity) AS label FROM lineitem GROUP BY 1, 2")
def dedup_labels(s, d):
    items = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("label"))
    return T.dedup(Graph(items, 0)).arcs


@query("arc_range", "SELECT src, dst FROM g WHERE src BETWEEN 100 AND 149", PARTS)
def arc_range(s, d):
    return views.parts_graph(s, d)[0].between(100, 50)


@query("arc_lines", "SELECT CAST(src AS VARCHAR) || chr(9) || CAST(dst AS VARCHAR) AS value FROM g", ORDERS)
def arc_lines(s, d):
    return A.to_arc_lines(_orders(s, d))


@query("adjacency_lines", """SELECT id, CAST(id AS VARCHAR) || chr(9) || coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst), '') AS value
FROM v LEFT JOIN g ON src = id GROUP BY id""", ORDERS)  # fmt: skip
def adjacency_lines(s, d):
    return A.to_adjacency_lines(_orders(s, d))


@query("adjacency_round_trip", "SELECT src, dst FROM g", ORDERS)
def adjacency_round_trip(s, d):
    return A.from_adjacency_lines(A.to_adjacency_lines(_orders(s, d)).select("value")).arcs


@query("named_arcs", f"WITH {views.LINKS_SQL} SELECT DISTINCT x.id AS src, y.id AS dst FROM l JOIN names x ON x.name = a JOIN names y ON y.name = b")
def named_arcs(s, d):
    return A.from_names(views.links(s, d))[0].arcs


@query("node_names", f"WITH {views.LINKS_SQL} SELECT id, name FROM names")
def node_names(s, d):
    return A.from_names(views.links(s, d))[1].select("id", "name")


@query("cumulative_degrees", """SELECT id, coalesce(sum(d) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS arcs_before
FROM (SELECT id, count(src) AS d FROM (SELECT id FROM v UNION ALL SELECT count(*) FROM v) LEFT JOIN g ON src = id GROUP BY id)""", ORDERS)  # fmt: skip
def cumulative_degrees(s, d):
    return S.cumulative_degrees(_orders(s, d))


@query("graph_summary", """+ o AS (SELECT id, count(src) AS d, min(dst) AS lo, max(dst) AS hi, count(*) FILTER (WHERE src = dst) AS loops, coalesce(sum(abs(dst - src)), 0) AS far FROM v LEFT JOIN g ON src = id GROUP BY id),
i AS (SELECT id, count(dst) AS d FROM v LEFT JOIN g ON dst = id GROUP BY id)
SELECT count(*) AS nodes, sum(d)::BIGINT AS arcs, sum(loops)::BIGINT AS loops, count(*) FILTER (WHERE d = 0) AS dangling, count(*) FILTER (WHERE d = 0 OR (d = 1 AND loops = 1)) AS terminal,
  min(d) AS min_outdegree, (SELECT id FROM o ORDER BY d, id LIMIT 1) AS min_outdegree_node, max(d) AS max_outdegree, (SELECT id FROM o ORDER BY d DESC, id LIMIT 1) AS max_outdegree_node,
  (SELECT min(d) FROM i) AS min_indegree, (SELECT id FROM i ORDER BY d, id DESC LIMIT 1) AS min_indegree_node, (SELECT max(d) FROM i) AS max_indegree, (SELECT id FROM i ORDER BY d DESC, id DESC LIMIT 1) AS max_indegree_node,
  round(sum(CASE WHEN d > 1 THEN hi - lo + CASE WHEN lo >= id THEN 2 * (lo - id) ELSE -2 * (lo - id) - 1 END ELSE 0 END) / sum(d), 6) AS successor_avg_gap,
  round(sum(far) / sum(d), 6) AS avg_locality FROM o""", ORDERS)  # fmt: skip
def graph_summary(s, d):
    return S.summary(_orders(s, d))


@query("log_deltas", "SELECT CAST(length(bin(abs(dst - src))) - 1 AS BIGINT) AS bin, count(*) AS arcs FROM g WHERE src <> dst GROUP BY 1", ORDERS)
def log_deltas(s, d):
    return S.log_deltas(_orders(s, d))


LOG_GAP = """SELECT coalesce(sum(CASE WHEN b IS NULL THEN length(bin(abs(src - dst) + 1)) - 1 ELSE length(bin(dst - b)) - 1 END), 0)::BIGINT AS cost
FROM (SELECT src, dst, lag(dst) OVER (PARTITION BY src ORDER BY dst) AS b FROM g)"""


@query("log_gap_cost", LOG_GAP, PARTS)
def log_gap_cost(s, d):
    return S.log_gap_cost(views.parts_graph(s, d)[0])


@query("code_sizes", """+ x AS (SELECT CASE WHEN b IS NULL THEN 'first' ELSE 'gap' END AS part, CASE WHEN b IS NULL THEN CASE WHEN dst >= src THEN 2 * (dst - src) ELSE -2 * (dst - src) - 1 END ELSE dst - b - 1 END AS x
  FROM (SELECT src, dst, lag(dst) OVER (PARTITION BY src ORDER BY dst) AS b FROM g) UNION ALL SELECT 'outdegree', count(src) FROM v LEFT JOIN g ON src = id GROUP BY id),
l AS (SELECT part, x, length(bin(x + 1)) - 1 AS lg FROM x)
SELECT part, 'unary' AS code, sum(x + 1)::BIGINT AS bits FROM l GROUP BY part
UNION ALL SELECT part, 'gamma', sum(2 * lg + 1)::BIGINT FROM l GROUP BY part
UNION ALL SELECT part, 'delta', sum(lg + 2 * (length(bin(lg + 1)) - 1) + 1)::BIGINT FROM l GROUP BY part""", ORDERS)  # fmt: skip
def code_sizes(s, d):
    return S.code_sizes(_orders(s, d)).where("code in ('unary', 'gamma', 'delta')")


@query("graph_differences", "SELECT src, dst, 'left' AS side FROM g WHERE src = dst", EVENTS)
def graph_differences(s, d):
    g = views.events_graph(s, d)
    return T.differences(g, T.without_loops(g))


@query("asymmetric_arcs", "SELECT src, dst FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.src = g.dst AND h.dst = g.src)", ORDERS)
def asymmetric_arcs(s, d):
    g = _orders(s, d)
    return g.arcs.join(T.transpose(g).arcs, ["src", "dst"], "left_anti")


def _bfs_sql(roots: str, extra: str = "") -> str:
    return f"""+ b(id, distance) USING KEY (id) AS (SELECT id, 0 FROM v WHERE id IN ({roots}) UNION
  SELECT g.dst, min(b.distance + 1) FROM b JOIN g ON g.src = b.id LEFT JOIN recurring.b r ON r.id = g.dst WHERE r.id IS NULL {extra} GROUP BY g.dst)"""


@query("bfs", _bfs_sql("0, 7") + """ SELECT b.id, b.distance, CASE WHEN b.distance = 0 THEN b.id ELSE min(p.id) END AS pred
FROM b LEFT JOIN g ON g.dst = b.id LEFT JOIN b p ON p.id = g.src AND p.distance = b.distance - 1 GROUP BY b.id, b.distance""", ORDERS)  # fmt: skip
def bfs(s, d):
    return V.bfs(_orders(s, d), [0, 7])


@query("bfs_filtered", _bfs_sql("2", "AND g.dst % 3 <> 0") + " SELECT id, distance FROM b", ORDERS)
def bfs_filtered(s, d):
    return V.bfs(_orders(s, d), [2], lambda i, p, k: i % 3 != 0).select("id", "distance")


@query("frontier_sizes", _bfs_sql("0") + " SELECT distance, count(*) AS size FROM b GROUP BY distance", ORDERS)
def frontier_sizes(s, d):
    return V.frontier_sizes(V.bfs(_orders(s, d), [0]))


@query("ball", _bfs_sql("0") + " SELECT id, distance FROM b WHERE distance <= 4", ORDERS)
def ball(s, d):
    return V.ball(_orders(s, d), 0, 4)


@query("bfs_order")
def bfs_order(s, d):
    return V.bfs_order(_orders(s, d), [0])


@query("bfs_permutation")
def bfs_permutation(s, d):
    return V.bfs_permutation(views.events_graph(s, d))


CLOSURE = """+ c(a, b) AS (SELECT src, dst FROM g UNION SELECT c.a, g.dst FROM c JOIN g ON g.src = c.b)"""
SCC = CLOSURE + """, scc AS (SELECT x.a AS id, min(x.b) AS m FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
s AS (SELECT v.id, least(v.id, coalesce(m, v.id)) AS component FROM v LEFT JOIN scc ON scc.id = v.id)"""


@query("connected_components", """+ u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), c(a, b) AS (SELECT src, dst FROM u UNION SELECT c.a, u.dst FROM c JOIN u ON u.src = c.b),
l AS (SELECT id, least(id, coalesce((SELECT min(b) FROM c WHERE a = id), id)) AS low FROM v)
SELECT id, dense_rank() OVER (ORDER BY low) - 1 AS component FROM l""", ORDERS)  # fmt: skip
def connected_components(s, d):
    return C.symmetric_components(T.symmetrize(_orders(s, d)))


@query("strong_components", SCC + " SELECT id, component FROM s", ORDERS)
def strong_components(s, d):
    return C.strong_components(_orders(s, d))


@query("component_sizes", SCC + " SELECT size, count(*) AS components FROM (SELECT count(*) AS size FROM s GROUP BY component) GROUP BY size", ORDERS)
def component_sizes(s, d):
    return S.size_distribution(C.strong_components(_orders(s, d)))


@query("components_by_size", SCC + """, k AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS r FROM s GROUP BY component)
SELECT id, r AS component FROM s JOIN k USING (component)""", ORDERS)  # fmt: skip
def components_by_size(s, d):
    return C.renumber_by_size(C.strong_components(_orders(s, d)))


@query("condensation", SCC + """, i AS (SELECT dst, count(*) AS k FROM g GROUP BY dst), o AS (SELECT src, count(*) AS k FROM g GROUP BY src),
r AS (SELECT x.component AS a, y.component AS b, g.src, g.dst, row_number() OVER (PARTITION BY x.component, y.component
    ORDER BY coalesce(i.k, 0) + coalesce(o.k, 0) DESC, g.src, g.dst) AS n
  FROM g JOIN s x ON x.id = g.src JOIN s y ON y.id = g.dst LEFT JOIN i ON i.dst = g.src LEFT JOIN o ON o.src = g.dst WHERE x.component <> y.component)
SELECT a AS src, b AS dst, src AS start, dst AS "end" FROM r WHERE n = 1""", ORDERS)  # fmt: skip
def condensation(s, d):
    g = _orders(s, d)
    return C.condensation(g, C.strong_components(g))


@query("topological_levels", "+ t(id, level) AS (SELECT id, 0 FROM v UNION SELECT g.dst, t.level + 1 FROM t JOIN g ON g.src = t.id) SELECT id, max(level) AS level FROM t GROUP BY id", TREE)
def topological_levels(s, d):
    return C.topological_levels(views.tree_graph(s, d))


@query("acyclic", "SELECT 'tree' AS graph, true AS acyclic UNION ALL SELECT 'orders', false")
def acyclic(s, d):
    return s.createDataFrame([("tree", C.is_acyclic(views.tree_graph(s, d))), ("orders", C.is_acyclic(_orders(s, d)))], "graph string, acyclic boolean")


def _pagerank_sql(mode: str, rounds: int, alpha: float = 0.85) -> str:
    u = {"strong": "(SELECT l FROM l{i}) * v.p", "weak": "(SELECT l FROM l{i}) / (SELECT count(*) FROM v)", "pseudo": "0"}[mode]
    out = "+ o AS (SELECT src, count(*) AS k FROM g GROUP BY src), p0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS p, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v)"
    for i in range(rounds):
        out += f""", l{i} AS (SELECT coalesce(sum(x), 0) AS l FROM p{i} WHERE id NOT IN (SELECT src FROM o)),
s{i} AS (SELECT g.dst, sum(x / k) AS got FROM g JOIN p{i} ON p{i}.id = g.src JOIN o ON o.src = g.src GROUP BY g.dst),
p{i + 1} AS (SELECT v.id, v.p, {alpha} * (coalesce(got, 0) + {u.format(i=i)}) + (1 - {alpha}) * v.p AS x FROM p{i} v LEFT JOIN s{i} ON s{i}.dst = v.id)"""
    return out + f" SELECT id, round(x, 9) AS value FROM p{rounds}"


for _mode in (R.STRONG, R.WEAK, R.PSEUDO):

    @query(f"pagerank_{_mode}", _pagerank_sql(_mode, 5), ORDERS)
    def pagerank(s, d, mode=_mode):
        return R.pagerank(_orders(s, d), mode=mode, stop=P.max_iterations(5)).ranks.select("id", F.round("value", 9).alias("value"))


@query("pagerank_converged")
def pagerank_converged(s, d):
    return R.pagerank(_orders(s, d), stop=P.l1_norm(1e-6) | P.max_iterations(100)).ranks


def _birank_sql(rounds: int) -> str:
    out = """+ o AS (SELECT src, count(*) AS k FROM g GROUP BY src), i AS (SELECT dst, count(*) AS k FROM g GROUP BY dst),
w AS (SELECT g.src, g.dst, 1 / sqrt(o.k * i.k) AS w FROM g JOIN o ON o.src = g.src JOIN i ON i.dst = g.dst),
u0 AS (SELECT id, 1.0::DOUBLE / (SELECT p FROM k) AS p, 1.0::DOUBLE / (SELECT p FROM k) AS x FROM v WHERE id < (SELECT p FROM k)),
t0 AS (SELECT id, 1.0::DOUBLE / (SELECT s FROM k) AS p FROM v WHERE id >= (SELECT p FROM k))"""
    for i in range(rounds):
        out += f""", t{i + 1} AS (SELECT t0.id, t0.p, 0.85 * coalesce(sum(w.w * u.x), 0) + 0.15 * t0.p AS x FROM t0 LEFT JOIN w ON w.dst = t0.id LEFT JOIN u{i} u ON u.id = w.src GROUP BY t0.id, t0.p),
u{i + 1} AS (SELECT u0.id, u0.p, 0.85 * coalesce(sum(w.w * t.x), 0) + 0.15 * u0.p AS x FROM u0 LEFT JOIN w ON w.src = u0.id LEFT JOIN t{i + 1} t ON t.id = w.dst GROUP BY u0.id, u0.p)"""
    return out + f" SELECT id, round(x, 9) AS value FROM u{rounds} UNION ALL SELECT id, round(x, 9) FROM t{rounds}"


@query("birank", _birank_sql(3), PARTS)
def birank(s, d):
    g, p = views.parts_graph(s, d)
    return R.birank(g, p, stop=P.max_iterations(3)).ranks.select("id", F.round("value", 9).alias("value"))


PAIRS = """+ b(root, id, distance) USING KEY (root, id) AS (SELECT id, id, 0 FROM v UNION
  SELECT b.root, g.dst, min(b.distance + 1) FROM b JOIN g ON g.src = b.id LEFT JOIN recurring.b r ON r.root = b.root AND r.id = g.dst WHERE r.id IS NULL GROUP BY b.root, g.dst)"""


@query("neighbourhood_function", PAIRS + " SELECT distance, (sum(count(*)) OVER (ORDER BY distance))::BIGINT AS pairs FROM b GROUP BY distance", EVENTS)
def neighbourhood_function(s, d):
    return D.neighbourhood_function(D.ball_sizes(views.events_graph(s, d)))


@query("centralities", PAIRS + """, t AS (SELECT root AS id, count(*) AS reachable, sum(distance)::BIGINT AS total, round(sum(CASE WHEN distance > 0 THEN 1.0::DOUBLE / distance ELSE 0 END), 6) AS harmonic FROM b GROUP BY root)
SELECT id, reachable, total, harmonic, round(CASE WHEN total = 0 THEN 0 ELSE 1.0::DOUBLE / total END, 9) AS closeness, round(CASE WHEN total = 0 THEN 1 ELSE (reachable * reachable)::DOUBLE / total END, 6) AS lin,
  (reachable * reachable - total)::DOUBLE AS nieminen FROM t""", EVENTS)  # fmt: skip
def centralities(s, d):
    out = D.centralities(D.ball_sizes(views.events_graph(s, d)))
    return out.withColumns({"harmonic": F.round("harmonic", 6), "closeness": F.round("closeness", 9), "lin": F.round("lin", 6)})


@query("eccentricities", PAIRS + """ SELECT f.id, f.forward, k.backward FROM (SELECT root AS id, max(distance) AS forward FROM b GROUP BY root) f
JOIN (SELECT id, max(distance) AS backward FROM b GROUP BY id) k ON k.id = f.id""", EVENTS)  # fmt: skip
def eccentricities(s, d):
    return D.exact_eccentricities(views.events_graph(s, d))


@query("diameter", PAIRS + " SELECT max(distance) AS diameter FROM b", EVENTS)
def diameter(s, d):
    return D.ball_sizes(views.events_graph(s, d)).agg(F.max("distance").alias("diameter"))


@query("ball_sketches")
def ball_sketches(s, d):
    return D.ball_sketches(_orders(s, d), log2m=6).sums


@query("erdos_renyi")
def erdos_renyi(s, d):
    return T.erdos_renyi(s, 300, 0.05, seed=1).arcs


@query("random_permutation")
def random_permutation(s, d):
    return T.random_permutation(s, _orders(s, d).n, seed=3)


@query("compose_permutations", "SELECT id, id AS new_id FROM v", ORDERS)
def compose_permutations(s, d):
    g = _orders(s, d)
    p = T.random_permutation(s, g.n, seed=3)
    return T.compose(p, T.invert(p), _reversal(g), _reversal(g))


@query("label_ranks", "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS new_id FROM customer")
def label_ranks(s, d):
    return T.ranks_of_labels(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("label")))


@query("combine_labels", """WITH a AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS r, c_custkey // 7 AS l FROM customer),
x AS (SELECT a.id, a.r, a.l, b.r AS rl FROM a JOIN a b ON b.id = a.l),
y AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN (r, l) = (lag(r) OVER w, lag(l) OVER w) THEN 0 ELSE 1 END AS up FROM x WINDOW w AS (ORDER BY rl, l, r, id))
SELECT id, sum(up) OVER (ORDER BY rl, l, r, id)::BIGINT AS label FROM y""")  # fmt: skip
def combine_labels(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    result = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("label"))
    return L.combine_pair(result, c.select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 7).cast("long").alias("label")))


@query("label_propagation")
def label_propagation(s, d):
    return L.propagate(T.symmetrize(_orders(s, d), loops=False), 0.5).labels
