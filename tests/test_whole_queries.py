"""Queries over all sources and edges, against plain Python."""

import math
from collections import Counter, defaultdict

import pytest
from driftbasket.plans import registry
from driftbasket.plans.graphs import edges

D = registry.D


def e6(x):
    return math.floor(x * 1e6 + 0.500001)


def successors(spark, sf_dir, name):
    out = defaultdict(Counter)
    for r in edges(spark, sf_dir, name).collect():
        out[r.src][r.dst] += 1
    return out


def power(out, source, steps):
    x = {source: 1.0}
    for _ in range(steps):
        y = defaultdict(float, {source: 1 - D})
        for n, score in x.items():
            total = sum(out[n].values()) if n in out else 0
            for m, c in out[n].items() if n in out else ():
                y[m] += score * D * c / total
        x = y
    return x


def rows(spark, sf_dir, name, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in registry.queries()[name](spark, sf_dir).collect()}


def near(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1 for k in got)  # sums in another order


def test_vectors_of_all_edges(spark, sf_dir):
    out = successors(spark, sf_dir, "bipartite")
    a = {s: {n: D / len(ns) for n in ns} for s, ns in out.items()}
    b = defaultdict(Counter)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").collect():
        b[r.l_partkey + 100000][r.l_suppkey] += r.l_quantity / 1000
    top = {(s, n): e6(x) for s, ns in b.items() for n, x in sorted(ns.items(), key=lambda i: (-round(i[1], 9), i[0]))[:5]}
    near(rows(spark, sf_dir, "keep_top_per_source", "source", "node", "score_e6"), top)
    both = {s: set(a[s]) | set(b.get(s, ())) for s in a}
    near(rows(spark, sf_dir, "norm1_pairs", "source", "norm1_e6"), {(s,): e6(sum(abs(a[s].get(n, 0) - b.get(s, {}).get(n, 0)) for n in ns)) for s, ns in both.items()})
    near(rows(spark, sf_dir, "jaccard_pairs", "source", "jaccard_e6"), {(s,): e6(len(set(a[s]) & set(b.get(s, ()))) / len(ns)) for s, ns in both.items()})


@pytest.mark.parametrize("name,of,steps", [("exact_multi_source", "flow", 12), ("exact_dangling_loss", "tree", 10)])
def test_exact_of_all_sources(spark, sf_dir, name, of, steps):
    out = successors(spark, sf_dir, of)
    nodes = set(out) | {m for ns in list(out.values()) for m in ns}
    sources = [n for n in nodes if of == "flow" or n >= 1_000_000]
    near(rows(spark, sf_dir, name, "source", "node", "score_e6"), {(s, n): e6(x) for s in sources for n, x in power(out, s, steps).items()})


def test_errors_and_walks_of_all_sources(spark, sf_dir):
    out = successors(spark, sf_dir, "flow")
    nodes = set(out) | {m for ns in list(out.values()) for m in ns}
    got = {r.source for r in registry.queries()["basket_vs_exact_error"](spark, sf_dir).collect()}
    assert got == nodes
    trace = registry.queries()["walk_trace"](spark, sf_dir).collect()
    at = {(r.source, r.walk, r.step): r.node for r in trace}
    assert {(s, w) for s, w, k in at if k == 1} == {(s, w) for s in out for w in range(int(registry.WALKS * D))}
    assert all(n in out[s if k == 1 else at[s, w, k - 1]] for (s, w, k), n in at.items())
    visits = Counter((s, n) for (s, _, _), n in at.items())
    scores = rows(spark, sf_dir, "walk_scores", "source", "node", "score_e6")
    assert {s for s, _ in scores} == nodes
    near(scores, {k: e6((visits[k] + registry.WALKS * (k[0] == k[1])) / registry.WALKS) for k in scores})
