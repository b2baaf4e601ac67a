"""Fixtures with known results."""

import math

import pytest
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
from lattica.sources.arcs import from_arcs

CANON = [(0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (2, 4), (3, 6), (4, 6), (5, 6), (5, 7), (6, 2)]


def arcs(g):
    return sorted(tuple(r) for r in g.arcs.select("src", "dst").collect())


def pairs(df):
    return dict(tuple(r) for r in df.collect())


def test_model_and_statistics(spark):
    g = from_arcs(spark, CANON)
    assert g.n == 8 and g.num_arcs() == 11 and g.has_arc(6, 2) and not g.has_arc(2, 6)
    assert [r[1] for r in S.cumulative_degrees(g).orderBy("id").collect()] == [0, 2, 5, 6, 7, 8, 10, 11, 11]
    s = S.summary(g).first()
    assert (s["max_indegree"], s["max_indegree_node"], s["dangling"], s["loops"]) == (3, 6, 1, 0)
    cuts = S.balanced_cutpoints(g, 3)
    assert cuts[0] == 0 and cuts[-1] == 8 and cuts == sorted(cuts)


def test_transforms(spark):
    tri = from_arcs(spark, [(0, 1), (0, 2), (1, 2)])
    assert arcs(T.transpose(tri)) == [(1, 0), (2, 0), (2, 1)]
    perm = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "id long, new_id long")
    assert arcs(T.permute(tri, perm)) == [(0, 1), (2, 0), (2, 1)]
    with pytest.raises(ValueError):
        T.permute(tri, perm.where("id < 2"))
    loop = from_arcs(spark, [(0, 1), (1, 2), (0, 0)])
    assert arcs(T.symmetrize(loop, loops=False)) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert arcs(T.symmetrize(loop)) == [(0, 0), (0, 1), (1, 0), (1, 2), (2, 1)]
    m = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id long, new_id long")
    assert arcs(T.map_nodes(from_arcs(spark, [(0, 1), (0, 2), (1, 2), (2, 3)]), m, 2)) == [(0, 0), (0, 1), (1, 1)]
    a = from_arcs(spark, [(0, 1), (0, 3), (1, 2), (2, 0), (2, 2), (2, 4), (3, 4), (3, 5), (4, 1)])
    b = from_arcs(spark, [(1, 2), (1, 3), (2, 1), (2, 3), (2, 4), (4, 0), (5, 1), (5, 2), (6, 6)])
    u = T.union(a, b)
    assert u.n == 7 and len(arcs(u)) == 16 and T.first_difference(u, T.union(b, a)) is None
    assert T.is_symmetric(T.symmetrize(a)) and not T.is_symmetric(a) and not T.is_symmetric(T.symmetrize(loop), simple=True)
    with pytest.raises(ValueError):
        from_arcs(spark, [(0, 1), (0, 1)], strict=True)


def test_visits(spark):
    g = from_arcs(spark, [(0, 1), (1, 2), (2, 0), (1, 3)])
    assert pairs(V.bfs(g, [0]).select("id", "distance")) == {0: 0, 1: 1, 2: 2, 3: 2}
    assert V.ball(from_arcs(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4)]), 0, 2).count() == 3
    assert V.top_sort(from_arcs(spark, [(0, 1), (0, 2), (2, 3), (1, 3)])) == [0, 2, 1, 3]
    assert sorted(pairs(V.bfs_permutation(g)).values()) == [0, 1, 2, 3]
    order = V.bfs_order(from_arcs(spark, CANON), [0]).orderBy("position").collect()
    assert [r["id"] for r in order] == [0, 1, 2, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        V.bfs_order(g, [])
    assert V.bfs(g, [0], lambda i, p, d: i != 1).count() == 1


@pytest.mark.parametrize("small", [0, 1000])
def test_strong_components(spark, small):
    g = from_arcs(spark, [(0, 0), (1, 0), (1, 2), (2, 1), (2, 3), (2, 4), (2, 5), (3, 4), (4, 3), (5, 5), (5, 6), (5, 7), (5, 8), (6, 7), (8, 7)])
    found = pairs(C.strong_components(g, small))
    sizes = sorted((list(found.values()).count(c) for c in set(found.values())), reverse=True)
    assert sizes == [2, 2, 1, 1, 1, 1, 1] and found[3] == found[4] == 3 and found[1] == found[2] == 1


def test_acyclicity_and_levels(spark):
    for rows, want in (([(1, 2), (0, 1)], True), ([(0, 1), (1, 2), (2, 0)], False), ([(0, 0)], False), ([(0, 1), (1, 0)], False)):
        assert C.is_acyclic(from_arcs(spark, rows)) == want
    assert pairs(C.topological_levels(from_arcs(spark, [(0, 1), (0, 2), (2, 3), (1, 3)]))) == {0: 0, 1: 1, 2: 1, 3: 2}
    comp = pairs(C.symmetric_components(T.symmetrize(from_arcs(spark, [(0, 3), (1, 2)], n=5))))
    assert comp == {0: 0, 3: 0, 1: 1, 2: 1, 4: 2}


def test_ranks(spark):
    g = from_arcs(spark, [(0, 1), (0, 2), (1, 2), (2, 0), (3, 0), (4, 3)])
    ranks = pairs(R.pagerank(g, stop=P.l1_norm(1e-8) | P.max_iterations(60)).ranks)
    assert math.isclose(sum(ranks.values()), 1, abs_tol=1e-7)
    b = pairs(R.birank(from_arcs(spark, [(0, 2), (1, 2), (1, 3)]), 2, 1, 1, stop=P.max_iterations(25)).ranks)
    assert math.isclose(b[1] / b[0], math.sqrt(2), rel_tol=1e-3) and math.isclose(b[2] / b[3], math.sqrt(2), rel_tol=1e-3)
    with pytest.raises(ValueError):
        R.birank(from_arcs(spark, [(0, 1)], n=3), 2)
    with pytest.raises(ValueError):
        P.l1_norm(float("nan"))


def test_distances(spark):
    g = from_arcs(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4)])
    ecc = {r["id"]: (r["forward"], r["backward"]) for r in D.eccentricities(D.all_distances(g)).collect()}
    assert [ecc[i][0] for i in range(5)] == [3, 3, 3, 4, 0] and [ecc[i][1] for i in range(5)] == [3, 3, 3, 3, 4]
    sweep = D.sum_sweep(g)
    rows = {r["id"]: (r["low_f"], r["low_b"]) for r in sweep.bounds.collect()}
    assert rows == ecc and (sweep.extremes.diameter, sweep.extremes.radius) == (4, 3)


def test_ball_sizes_as_from_all_pairs(spark, monkeypatch):
    # a random part over several blocks, a long path, loops, repeated arcs, nodes without arcs
    rows = [tuple(r) for r in T.erdos_renyi(spark, 90, 0.03, seed=4).arcs.collect()]
    rows += [(100 + i, 101 + i) for i in range(70)] + [(0, 0), (5, 5), (100, 101), (89, 100)]
    g = from_arcs(spark, rows, n=180)
    paired = D.all_distances(g)
    want = {tuple(r) for r in paired.groupBy("root", "distance").count().collect()}
    for roots in (64, 70, 512):
        monkeypatch.setattr(D.packed, "BLOCK_ROOTS", roots)
        monkeypatch.setattr(D.packed, "GATHER", 10 if roots == 70 else 500_000)
        sizes = D.ball_sizes(g)
        assert {tuple(r) for r in sizes.collect()} == want
    for f in (D.neighbourhood_function, D.centralities):
        rounded = [f(x).select(*[F.round(c, 9).alias(c) for c in f(x).columns]) for x in (sizes, paired)]
        assert rounded[0].schema == rounded[1].schema and sorted(rounded[0].collect()) == sorted(rounded[1].collect())
    assert sorted(D.exact_eccentricities(g).collect()) == sorted(D.eccentricities(paired).collect())
    assert D.ball_sizes(from_arcs(spark, [], n=0)).count() == 0


def test_distances_of_many_nodes(spark):
    """A graph whose pairs are more than rows can be: 60,000 nodes in 600 rings."""
    n, ring = 60_000, 100
    ids = spark.range(n)
    arcs = ids.select(F.col("id").alias("src"), F.when((F.col("id") + 1) % ring == 0, F.col("id") + 1 - ring).otherwise(F.col("id") + 1).alias("dst"))
    found = D.neighbourhood_function(D.ball_sizes(Graph(arcs, n))).collect()
    assert {r["distance"]: r["pairs"] for r in found} == {d: n * (d + 1) for d in range(ring)}


def test_ball_sketches_is_near_exact(spark):
    g = T.erdos_renyi(spark, 60, 0.05, seed=2)
    exact = pairs(D.centralities(D.all_distances(g)).select("id", "reachable"))
    ball = D.ball_sketches(g, log2m=10)
    error = max(abs(v - exact[k]) / exact[k] for k, v in pairs(ball.sums.select("id", "reachable")).items())
    assert error < 0.15 and ball.neighbourhood == sorted(ball.neighbourhood)


def test_labels(spark):
    g = T.symmetrize(from_arcs(spark, [(0, 1), (0, 2), (1, 3), (2, 3)]))
    for gamma in (0.0, 1.0):
        labels = pairs(L.propagate(g, gamma, max_rounds=3).labels)
        assert len(labels) == 4 and all(0 <= x < 4 for x in labels.values())
    order = pairs(L.layered_order(g, [0.0, 1.0], max_rounds=2))
    assert sorted(order.values()) == [0, 1, 2, 3]
    assert L.parse_gammas(["-0", "-1", "3-2", "2"]) == [1.0, 0.5, 0.75, 2.0]


def test_packed_labels_as_from_plans(spark, monkeypatch):
    g = T.symmetrize(T.erdos_renyi(spark, 60, 0.06, seed=5), loops=False)
    for gamma, seed in ((0.0, 0), (0.5, 3)):
        layers = []
        for most in (1_000_000, 0):
            monkeypatch.setattr(L.packed, "PACKED_ARCS", most)
            layers.append(L.propagate(g, gamma, seed, max_rounds=5))
        assert pairs(layers[0].labels) == pairs(layers[1].labels) and layers[0].updates == layers[1].updates
    monkeypatch.undo()
    # rounds on the table's plans are some jobs each; packed ones are one task
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    L.propagate(g, 0.5, 3)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 20
    assert pairs(L.propagate(from_arcs(spark, [], n=3), 0.5).labels) == {0: 0, 1: 1, 2: 2}


def test_spark_hashes():
    import numpy as np

    # select xxhash64(-5L, 3, 0), xxhash64(123456789012L, 7L, 0, 9)
    got = [int(L.packed.xxhash64(np.array([-5]), 3, 0)[0]), int(L.packed.xxhash64(np.array([123456789012]), np.array([7]), 0, 9)[0])]
    assert got == [-5357943967898918896, 5080363765717404198]


def test_visit_orders_by_plans_as_packed(spark, monkeypatch):
    """Restarts in the middle of what is left, equal levels, nodes without arcs; and no limit of arcs ends in an error."""
    def plain(rows, n):
        succ, seen, order = {}, set(), []
        for a, b in sorted(set(rows)):
            succ.setdefault(a, []).append(b)
        for root in range(n):
            queue = [] if root in seen else [root]
            seen.add(root)
            for x in queue:
                for y in succ.get(x, ()):
                    if y not in seen:
                        seen.add(y)
                        queue.append(y)
            order += queue
        return {x: i for i, x in enumerate(order)}

    rows = [tuple(r) for r in T.erdos_renyi(spark, 40, 0.04, seed=6).arcs.collect()] + [(45, 3), (45, 41), (44, 45), (7, 7), (45, 3)]
    g = from_arcs(spark, rows, n=48)
    want = plain(rows, 48)
    monkeypatch.setattr(V, "DRIVER_ARCS", 10)
    assert pairs(V.bfs_permutation(g)) == want
    monkeypatch.setattr(V.packed, "PACKED_ARCS", 10)
    assert pairs(V.bfs_permutation(g)) == want


def test_predicates():
    stop = P.max_iterations(3) & P.l1_norm(0.1)
    assert not stop(P.State(iteration=3, l1=0.2)) and stop(P.State(iteration=3, l1=0.1))
    assert P.few_modified()(P.State(modified=3, nodes=9)) and not P.few_modified()(P.State(modified=4, nodes=9))


def test_random_permutation_and_composition(spark):
    p = T.random_permutation(spark, 50, seed=4)
    assert sorted(pairs(p).values()) == list(range(50))
    assert all(a == b for a, b in pairs(T.compose(p, T.invert(p))).items())
    assert spark.range(3).select(F.lit(1)).count() == 3


def test_components_by_star_steps_as_in_one_task(spark):
    import random

    from lattica.operators.components import connected_components

    rng = random.Random(5)
    arcs = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(500, 500)]
    edges = spark.createDataFrame(arcs, "src long, dst long").repartition(7)
    one, many = ({r["id"]: r["component"] for r in connected_components(edges, one_task=n).collect()} for n in (10_000, 0))
    up = {x: x for a in arcs for x in a}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in arcs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    assert one == many == {x: top(x) for x in up}
