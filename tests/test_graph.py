"""Fixtures with known results: shapes, closed forms, orderings, error messages."""

import hashlib
import math
import random

import pytest
from driftbasket.__main__ import run
from driftbasket.functions.metrics import jaccard, kendall_tau_b, norm1
from driftbasket.graph import Graph
from driftbasket.operators.baskets import baskets
from driftbasket.operators.exact import exact_multi_source, exact_single_source
from driftbasket.operators.partition import find_partitions
from driftbasket.operators.quality_report import benchmark_report
from driftbasket.operators import walks
from driftbasket.operators.topk import keep_top, to_maps
from driftbasket.operators.walks import degree_order, monte_carlo, queue_order, walk_baskets, walk_trace
from driftbasket.plans.graphs import graph
from driftbasket.sources.edge_csv import parse_edges, read_edge_csv
from pyspark.sql import functions as F


def maps(df):
    out = {}
    for s, n, x in df.select("source", "node", "score").collect():
        out.setdefault(s, {})[n] = x
    return out


def adj(spark, g):
    return Graph.from_adjacency(spark, g)


CYCLE6 = {i: [(i + 1) % 6] for i in range(6)}


def star_in(loop=False):
    return {0: [0] if loop else [], **{i: [0] for i in range(1, 6)}}


def model(graph, source, steps=200, d=0.85):
    """Plain power iteration."""
    x = {source: 1.0}
    for _ in range(steps):
        y = {source: 1 - d}
        for n, s in x.items():
            for t in graph[n]:
                y[t] = y.get(t, 0) + s * d / len(graph[n])
        x = y
    return x


def test_cycle(spark):
    report = {}
    got = maps(baskets(adj(spark, CYCLE6), 10, 30, 200, tolerance=1e-4, report=report))
    for i in range(6):
        for k in range(6):
            assert got[i][(i + k) % 6] == pytest.approx(0.15 * 0.85**k / (1 - 0.85**6), abs=1e-4)
    assert report["half_sweeps"] == 62


def test_cut_cycle(spark):
    got = maps(baskets(adj(spark, CYCLE6), 3, 3, 80))
    for i in range(6):
        assert got[i] == pytest.approx({i: 0.15, (i + 1) % 6: 0.1275, (i + 2) % 6: 0.108375}, abs=3e-3)


def test_star(spark):
    report = {}
    got = maps(baskets(adj(spark, star_in()), 10, 20, 50, tolerance=1e-4, report=report))
    assert got[0] == pytest.approx({0: 0.15}) and got[3] == pytest.approx({3: 0.15, 0: 0.1275}) and report["half_sweeps"] == 4
    assert maps(baskets(adj(spark, star_in(True)), 10, 20, 120))[2][0] == pytest.approx(0.85, abs=1e-4)


def test_no_edges_loops_and_nothing(spark):
    report = {}
    got = maps(baskets(adj(spark, {i: [] for i in range(10)}), 5, 5, 20, tolerance=1e-4, report=report))
    assert all(got[i] == pytest.approx({i: 0.15}) for i in range(10)) and report["half_sweeps"] == 2
    assert maps(baskets(adj(spark, {0: [0]}), 5, 5, 60))[0][0] == pytest.approx(1.0, abs=1e-3)
    assert baskets(adj(spark, {}), 5, 5, 5).count() == 0


@pytest.mark.parametrize("kind", ["random", "multi"])
def test_against_power_iteration(spark, kind):
    rng = random.Random(1)
    g = {i: [rng.randrange(20) for _ in range(12)] for i in range(20)}
    if kind == "multi":
        g |= {0: [0, 0, 1, 1, 1], 19: []}
    got = maps(baskets(adj(spark, g), 20, 20, 80))
    for i in (0, 7, 19):
        want = model(g, i)
        assert got[i] == pytest.approx({n: want[n] for n in got[i]}, abs=1e-4) and len(got[i]) == min(20, len(want))


def test_strings_are_nodes_too(spark):
    got = maps(baskets(adj(spark, {"a": ["b"], "b": []}), 2, 2, 4))
    assert got["a"] == pytest.approx({"a": 0.15, "b": 0.1275})


def test_exact(spark):
    diamond = adj(spark, {0: [1, 2], 1: [3], 2: [3], 3: [0]})
    x = {r.node: r.score for r in exact_single_source(diamond, 0, 100, 0.85, 1e-3).collect()}
    assert x == pytest.approx({0: 0.388568, 1: 0.165141, 2: 0.165141, 3: 0.28115}, abs=1e-3)
    both = maps(exact_multi_source(diamond, spark.createDataFrame([(0,), (3,)], "source long"), 30, tolerance=-1))
    assert both[3][3] > both[3][0] > both[3][1]
    zero = maps(exact_multi_source(diamond, spark.createDataFrame([(0,)], "source long"), 2, damping=0.0, tolerance=-1))
    assert zero[0] == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0}


def test_sides(spark):
    sizes = lambda g: sorted(r["count"] for r in find_partitions(adj(spark, g)).groupBy("side").count().collect())
    assert sizes({i: [] for i in range(9)}) == [9]
    assert sizes({0: list(range(10)), **{i: [] for i in range(1, 10)}}) == [1, 9]
    assert sizes({**{i: [i + 10] for i in range(10)}, **{i + 10: [i] for i in range(10)}}) == [10, 10]
    assert sizes({i: list(range(12)) for i in range(12)}) == [1, 11]
    assert sizes({i: [(i + 1) % 12] for i in range(12)}) == [6, 6]


def test_monte_carlo(spark):
    got = maps(monte_carlo(adj(spark, star_in()), 10, 20, 100))
    assert got[0] == {0: 1.0} and all(got[i][0] == pytest.approx(0.85) for i in range(1, 6))
    star = {0: [1, 2, 3, 4, 5], **{i: [i] for i in range(1, 6)}}
    got = maps(monte_carlo(adj(spark, star), 10, 20, 200))
    assert all(got[0][i] == pytest.approx(got[i][i] * 0.85 / 5) for i in range(1, 6))
    out = maps(monte_carlo(adj(spark, {0: [1, 2, 3], 1: [], 2: [], 3: []}), 10, 20, 50))
    assert out[0] == pytest.approx({0: 1.0, 1: 0.85 / 3, 2: 0.85 / 3, 3: 0.85 / 3})


def test_monte_carlo_estimates_visits(spark):
    rng = random.Random(4)
    g = {i: [rng.randrange(12) for _ in range(4)] for i in range(12)}
    got = maps(monte_carlo(adj(spark, g), 12, 12, 2000))
    for i in (0, 5):
        want = model(g, i)
        assert sum(abs(got[i].get(n, 0) * 0.15 - want[n]) for n in want) < 0.1


def walked_in_turn(g):
    """The order by a queue that one process keeps."""
    into = {n: sorted(s for s, ts in g.items() for t in ts if t == n) for n in g}
    left, done, out = {n: len(ts) for n, ts in g.items()}, set(), []
    for seed in sorted(g, key=lambda n: (-len(into[n]), len(g[n]), n)):
        line = [] if seed in done else [seed]
        for n in line:
            done.add(n)
            out.append(n)
            for p in into[n]:
                left[p] -= 1
                if left[p] == 0 and p not in done:
                    line.append(p)
    return out


def in_order(df):
    rows = df.orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(rows)))
    return [r.id for r in rows]


def test_orders(spark):
    g = {0: [1, 2], 1: [2], 2: [], 3: [2, 2]}
    assert in_order(degree_order(adj(spark, g))) == [2, 1, 0, 3]
    assert in_order(queue_order(adj(spark, g))) == walked_in_turn(g)
    assert queue_order(adj(spark, {})).count() == 0


@pytest.mark.parametrize("seed,edges", [(1, 25), (3, 70)])
def test_queue_order_of_random_graphs(spark, seed, edges):
    rng = random.Random(seed)
    g = {n: [] for n in range(30)}
    for _ in range(edges):
        a, b = rng.randrange(30), rng.randrange(30)
        g[max(a, b) if rng.random() < 0.8 else a].append(min(a, b))
    assert in_order(queue_order(adj(spark, g))) == walked_in_turn(g)


def test_chain_is_exact(spark, monkeypatch):
    """A node combines the final baskets of what comes before it, so few walks are enough. Many parts become one."""
    monkeypatch.setattr(walks, "PARTS", 3)
    g = {n: [n + 1] for n in range(11)} | {11: []}
    got = maps(monte_carlo(adj(spark, g), 12, 12, 20))
    assert all(got[n] == pytest.approx({m: 0.85 ** (m - n) for m in range(n, 12)}, abs=1e-9) for n in g)


def test_final_baskets_of_earlier_nodes_walks_of_later_ones(spark):
    rng = random.Random(9)
    g = {n: [rng.randrange(14) for _ in range(3)] for n in range(14)} | {14: []}
    graph = adj(spark, g)
    order = walked_in_turn(g)
    walked = maps(walk_baskets(graph, graph.vertices.withColumnRenamed("id", "source"), 15, 30))
    final = {}
    for n in order:
        mine = {n: 1.0}
        for t in g[n]:
            for m, x in (final.get(t) or walked[t]).items():
                mine[m] = mine.get(m, 0) + x * 0.85 / len(g[n])
        final[n] = mine
    got = maps(monte_carlo(graph, 15, 15, 30))
    assert all(got[n] == pytest.approx(final[n], abs=1e-9) for n in g)


def test_long_walks_are_never_cut(spark):
    trace = walk_trace(adj(spark, {0: [0]}), spark.createDataFrame([(0,)], "source long"), 3, 0.97)
    steps = {r.walk: r["max(step)"] for r in trace.groupBy("walk").max("step").collect()}
    stay = lambda w, k: int(hashlib.md5(f"walk:0:{w}:{k}:stay".encode()).hexdigest()[:8], 16) / 2**32 <= 0.97
    assert steps == {w: next(k for k in range(2, 10_000) if not stay(w, k)) - 1 for w in range(2)}
    with pytest.raises(ValueError):
        walk_trace(adj(spark, {0: [0]}), spark.createDataFrame([(0,)], "source long"), 3, 1.0)


def test_kendall_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.randrange(m), rng.randrange(k)) for s, (n, m, k) in enumerate([(40, 60, 60), (40, 4, 5), (1, 3, 3), (9, 1, 5), (9, 5, 1), (6, 1, 1), (64, 1000, 2)]) for i in range(n)]
    got = {r.source: r.kendall for r in kendall_tau_b(spark.createDataFrame(rows, "source long, item long, x long, y long")).collect()}
    sign = lambda a, b: (a > b) - (a < b)
    for s in got:
        own = [(x, y) for k, _, x, y in rows if k == s]
        pairs = [(sign(a[0], b[0]), sign(a[1], b[1])) for i, a in enumerate(own) for b in own[:i]]
        num, nx, ny = sum(a * b for a, b in pairs), sum(abs(a) for a, _ in pairs), sum(abs(b) for _, b in pairs)
        assert got[s] == pytest.approx(1.0 if not pairs else num / math.sqrt(nx * ny) if nx * ny else float(nx == ny))


def test_driver_program(spark, tmp_path, capsys):
    (tmp_path / "edges.txt").write_text("1, 2\n2, 3\n3, 1\n1, 2\n3, 4\n")
    run(spark, str(tmp_path / "edges.txt"), K=4, L=6, iterations=2, walks=4, nodes=5, threads=2)
    said = capsys.readouterr().out
    assert said.startswith("nodes: 4 edges: 4\n") and said.count("run-time = ") == 3 and said.count("jaccard_average     ") == 3



def test_report(spark):
    g = adj(spark, {i: [(i + 1) % 8, (i + 3) % 8] for i in range(8)})
    exact = exact_multi_source(g, g.vertices.withColumnRenamed("id", "source"))
    r = benchmark_report(exact, g, 4).first()
    assert r["jaccard_average"] == r["kendall_min"] == 1.0 and r["average_map_size"] == 8
    none = spark.createDataFrame([], "source long, node long, score double")
    assert tuple(benchmark_report(none, g, 4).first()) == (-1.0,) * 5
    alone = adj(spark, {0: []})
    assert tuple(benchmark_report(spark.createDataFrame([(0, 0, 1.0)], none.schema), alone, 4, True).first()) == (-1.0,) * 5


def test_helpers(spark):
    b = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.7), (0, 3, 0.5)], "source long, node long, score double")
    assert maps(keep_top(b, 2)) == {0: {2: 0.7, 1: 0.5}} and keep_top(b, 0).count() == 0 and keep_top(b, 9).count() == 3
    assert to_maps(b).first()["basket"] == {1: 0.5, 2: 0.7, 3: 0.5}
    assert norm1(b, b.where("node > 1")).first()["norm1"] == pytest.approx(0.5)
    arrays = spark.sql("select array() a, array() b union all select array(1), array() union all select array(1, 2), array(2, 3)")
    assert [r[0] for r in arrays.select(jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]
    cases = {1: ([1, 2, 3], [3, 2, 1], -1.0), 2: ([1, 1, 2], [1, 2, 2], 0.5), 3: ([1], [5], 1.0), 4: ([1, 1], [1, 2], 0.0), 5: ([1, 1], [2, 2], 1.0)}
    rows = [(k, i, float(x), float(y)) for k, (xs, ys, _) in cases.items() for i, (x, y) in enumerate(zip(xs, ys))]
    got = {r.source: r.kendall for r in kendall_tau_b(spark.createDataFrame(rows, "source long, item int, x double, y double")).collect()}
    assert got == pytest.approx({k: c[2] for k, c in cases.items()})


def test_csv(spark, tmp_path):
    lines = ["1,2", "1,2", " 4 , 5 ", "1.7,2", "1,2,3", "7,8abc", "9,10\r", "3"]
    good = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in parse_edges(good).collect()] == [(1, 2), (1, 2), (4, 5), (1, 2), (1, 2), (7, 8), (9, 10), (3, 3)]
    bad = spark.createDataFrame([("",), ("x,y",), ("1,2",)], "value string")
    assert [tuple(r) for r in parse_edges(bad, "PERMISSIVE").collect()] == [(1, 2)]
    with pytest.raises(Exception, match="not an edge"):
        parse_edges(bad).collect()
    (tmp_path / "e.txt").write_text("1, 2\n1,2\n2,3\n")
    g = read_edge_csv(spark, str(tmp_path / "e.txt"))
    assert g.edges.count() == 2 and g.vertices.count() == 3
    assert read_edge_csv(spark, str(tmp_path / "none.txt")).vertices.count() == 0


def test_messages(spark):
    g = adj(spark, {0: []})
    for args, message in (((0, 1, 1), "K must be positive"), ((1, 0, 1), "L must be positive"), ((2, 1, 1), "K must be <= L"), ((1, 1, 0), "iterations must be positive"), ((1, 1, 1, 2.0), r"damping must be \[0,1\]")):
        with pytest.raises(ValueError, match=message):
            baskets(g, *args)
        with pytest.raises(ValueError, match=message):
            monte_carlo(g, *args)
    with pytest.raises(ValueError, match="nThreads must be positive"):
        baskets(g, 1, 1, 1, nThreads=0)
    with pytest.raises(ValueError, match="source node not part of the graph"):
        exact_single_source(g, 9)
    with pytest.raises(ValueError, match="testNodes must be positive"):
        benchmark_report(spark.createDataFrame([], "source long, node long, score double"), g, 0)
    with pytest.raises(ValueError, match="node 5 in the provided map is not part of the provided graph"):
        benchmark_report(spark.createDataFrame([(5, 5, 1.0)], "source long, node long, score double"), g)
    with pytest.raises(ValueError, match="not a node"):
        adj(spark, {0: [1]})


def test_empty_graph_of_tables(spark, sf_dir):
    g = graph(spark, sf_dir, "trade_sparse")
    assert g.vertices.count() == 0 and baskets(g, 2, 2, 3).count() == 0
