"""Monte-Carlo baskets: seeded random walks, and exact one-step combination in a heuristic order.

Scores estimate expected visits, personalized PageRank / (1 - damping). Walks are rows: each step is an equi-join of
the walks' places with the edges, and all choices come from a hash of (seed, source, walk, step), so any
part can be computed again on another executor. A node combines the final baskets of all successors that come before it in
the execution order with walk baskets of the others (itself, if it is one, among them). It is combined as soon
as those are: level by level, a join and a sum each (on graphs that held.py takes, a step over arrays).

The execution order is that of a queue. Nodes by degree are seeds; a node whose successors have all come joins the
queue at once. In queue_order() no task holds the graph: which seed's queue a node joins is a fixed point of maxima over
successors, and within the queues the nodes of one depth are ranked after their last successors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import discard, materialize
from . import held
from .checks import check
from .topk import keep_top

#: Steps or levels whose tables are read apart; beyond, they are written as one.
PARTS = 24


def uniform(*parts: Column | str) -> Column:
    """[0, 1) from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


class _Parts:
    """A table that grows: few tables on disk, whatever the number of parts."""

    def __init__(self, tag: str):
        self.tag, self.parts = tag, []

    def add(self, part: DataFrame) -> None:
        """part: written by materialize(). It stays as it is until the next one comes."""
        if len(self.parts) >= PARTS:
            one = materialize(self.all(), self.tag)
            discard(self.parts)
            self.parts = [one]
        self.parts.append(part)

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out


def _ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with ord = 0, 1, ... in this order. The rank is found by range partitions, not by one task."""
    columns = rows.columns
    sorted_ = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    sorted_ = materialize(sorted_, "order")
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_place")) - 1
    return sorted_.join(starts, "_part").select(*columns, (F.col("_start") + within).alias("ord"))


def degree_order(graph: Graph) -> DataFrame:
    """(id, ord): indegree falling, outdegree rising, id rising."""
    return _ranked(graph.degrees(), F.desc("indegree"), "outdegree", "id").select("id", "ord")


def _queues(graph: Graph, ranks: DataFrame) -> DataFrame:
    """(id, rank, queue): the rank of the seed whose queue a node joins. That is its own rank, or if all its successors have
    come in an earlier queue's run the latest of these; the greatest solution of queue = min(rank, max of the successors')."""
    edges = materialize(graph.edges.select("src", "dst").distinct(), "edges")
    now = materialize(ranks.select("id", F.col("ord").alias("rank"), F.col("ord").alias("queue")), "queues")
    while True:
        latest = edges.join(now.select(F.col("id").alias("dst"), "queue"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("queue").alias("latest"))
        moved = now.join(latest, "id", "left").select("id", "rank", F.least("queue", "latest").alias("queue"), (F.col("latest") < F.col("queue")).alias("moved"))
        after = materialize(moved.withColumn("moved", F.coalesce("moved", F.lit(False))), "queues")
        discard([now])
        now = after.select("id", "rank", "queue")
        if after.where("moved").isEmpty():
            discard([edges])
            return now


def queue_order(graph: Graph) -> DataFrame:
    """(id, ord): the order by degree, refined: once all successors of a node have come, it joins the queue; predecessors of
    one node join by id. As many rounds as the longest chain of a queue has nodes; degree_order has one."""
    ranks = materialize(degree_order(graph), "ranks")
    queues = materialize(_queues(graph, ranks), "queues")
    follow = queues.where("queue < rank")
    ends = graph.edges.select("src", "dst").distinct().join(follow.select(F.col("id").alias("src"), "queue"), "src")
    waits = materialize(ends.join(queues.select(F.col("id").alias("dst"), F.col("queue").alias("q")), "dst").where("q = queue").select("src", "dst"), "waits")
    need = materialize(waits.groupBy("src").agg(F.count("*").alias("need")), "need")
    frontier = materialize(_ranked(queues.where("queue = rank").select("id", "queue"), "queue").withColumn("depth", F.lit(0)), "depth")
    placed = _Parts("placed")
    placed.add(frontier)
    pending = None
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        come = waits.join(frontier.select(F.col("id").alias("dst"), "ord", "queue"), "dst").groupBy("src", "queue").agg(F.count("*").alias("got"), F.max("ord").alias("last"))
        if pending is not None:
            come = come.join(pending.withColumnRenamed("got", "before"), "src", "full").select("src", "queue", (F.coalesce("got", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("got"), "last")
        come = materialize(come.join(need, "src"), "come")
        ready = come.where("got = need and last is not null").select(F.col("src").alias("id"), "queue", "last")
        frontier = materialize(_ranked(ready, "last", "id").select("id", "queue", "ord").withColumn("depth", F.lit(depth)), "depth")
        before, pending = pending, materialize(come.where("got < need").select("src", "got"), "pending")
        discard([come, *([before] if before is not None else [])])
        placed.add(frontier)
    return _ranked(placed.all().withColumnRenamed("ord", "at"), "queue", "depth", "at").select("id", "ord")


def walk_trace(graph: Graph, sources: DataFrame, walks: int, damping: float = 0.85, seed: str = "walk") -> DataFrame:
    """(source, walk, step, node): floor(walks * damping) walks of each source(source) that has successors. The first
    hop is always made, to successor (walk + 1) mod outdegree; each further one with probability damping, until no walk
    is left."""
    if damping >= 1:
        raise ValueError("damping must be below 1 for walks")
    edges = materialize(graph.edges.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst")).alias("k")), "edges")
    out = materialize(edges.groupBy("src").agg(F.max("k").alias("n")), "out")
    n_walks = int(walks * damping)
    if not n_walks:
        return sources.select("source", F.lit(0).alias("walk"), F.lit(0).alias("step"), F.col("source").alias("node")).where("false")
    begin = sources.join(out, F.col("source") == F.col("src")).select("source", F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("walk"), "n")
    first = begin.select("source", "walk", ((F.col("walk") + 1) % F.col("n") + 1).cast("int").alias("k"))
    now = materialize(first.join(edges, (F.col("source") == F.col("src")) & (edges["k"] == first["k"])).select("source", "walk", F.lit(1).alias("step"), F.col("dst").alias("node")), "walks")
    trace, step = _Parts("walks"), 1
    while not now.isEmpty():
        step += 1
        key = lambda what: uniform(F.lit(seed), F.col("source").cast("string"), F.col("walk").cast("string"), F.lit(str(step)), F.lit(what))  # noqa: E731, B023
        alive = now.where(key("stay") <= damping).join(out, F.col("node") == F.col("src")).select("source", "walk", "node", (F.floor(key("hop") * F.col("n")) + 1).cast("int").alias("k"))
        after = materialize(alive.join(edges, (F.col("node") == F.col("src")) & (alive["k"] == edges["k"])).select("source", "walk", F.lit(step).alias("step"), F.col("dst").alias("node")), "walks")
        trace.add(now)
        now = after
    return trace.all() if trace.parts else now


def walk_baskets(graph: Graph, sources: DataFrame, L: int, walks: int, damping: float = 0.85, seed: str = "walk") -> DataFrame:  # noqa: N803
    """(source, node, score): visits / walks; a source is always in its basket, and the first L nodes seen. A source
    without successors has itself alone, with 1."""
    trace = walk_trace(graph, sources, walks, damping, seed)
    own = sources.select("source", F.col("source").alias("node"), F.lit(walks).cast("long").alias("visits"), F.lit(-1).alias("walk"), F.lit(0).alias("step"))
    seen = trace.groupBy("source", "node").agg(F.count("*").alias("visits"), F.min(F.struct("walk", "step")).alias("f")).select("source", "node", "visits", "f.walk", "f.step")
    all_ = own.unionByName(seen).groupBy("source", "node").agg(F.sum("visits").alias("visits"), F.min(F.struct("walk", "step", "node")).alias("f"))
    first = F.row_number().over(Window.partitionBy("source").orderBy("f"))
    return all_.withColumn("_k", first).where(F.col("_k") <= L).select("source", "node", (F.col("visits") / walks).alias("score"))


def monte_carlo(graph: Graph, K: int, L: int, iterations: int, damping: float = 0.85, seed: str = "walk", order: str = "queue") -> DataFrame:  # noqa: N803
    """(source, node, score): the K largest of each node; `iterations` is the number of walks. order: "queue", or "degree",
    which takes no rounds to find. damping 1 has endless walks and is refused. A graph of few enough edges (held.py) is ordered
    and combined as arrays, and a task makes the walks of its sources one by one; on others each round is a job."""
    check(K, L, iterations, damping)
    if damping == 1:
        raise ValueError("damping must be below 1 for walks")
    if (h := held.hold(graph)) and 0 < h.n * L <= held.HELD_ENTRIES:
        return _monte_carlo_held(graph, h, K, L, iterations, damping, seed, order)
    return monte_carlo_by_joins(graph, K, L, iterations, damping, seed, order)


def _monte_carlo_held(graph: Graph, h: held.Held, K: int, L: int, iterations: int, damping: float, seed: str, order: str) -> DataFrame:  # noqa: N803
    place = held.queue_order(h) if order == "queue" else held.degree_order(h)
    kind = graph.vertices.schema["id"].dataType.simpleString()
    later = np.unique(h.dst[place[h.dst] >= place[h.src]])
    needed = held.table(graph.vertices, {"source": h.ids.take(pa.array(later))}, f"source {kind}")
    walked = held.walk_baskets(h, needed, L, iterations, damping, seed).toArrow()
    nodes, scores = held.combined(h, place, walked, L, damping)
    nodes, scores = nodes[:, :K], scores[:, :K]
    source, k = np.nonzero(nodes >= 0)
    columns = {"source": h.ids.take(pa.array(source)), "node": h.ids.take(pa.array(nodes[source, k])), "score": scores[source, k]}
    return held.table(graph.vertices, columns, f"source {kind}, node {kind}, score double")


def monte_carlo_by_joins(graph: Graph, K: int, L: int, iterations: int, damping: float, seed: str, order: str) -> DataFrame:  # noqa: N803
    """The rows of monte_carlo(), for graphs of any size."""
    ranks = materialize(queue_order(graph) if order == "queue" else degree_order(graph), "ranks")
    place = lambda end: ranks.select(F.col("id").alias(end), F.col("ord").alias(f"{end}_ord"))
    weights = materialize(graph.weights(damping).join(place("src"), "src").join(place("dst"), "dst").select("src", "dst", "w", (F.col("dst_ord") < F.col("src_ord")).alias("final")), "weights")
    walked = materialize(walk_baskets(graph, materialize(weights.where("not final").select(F.col("dst").alias("source")).distinct(), "needed"), L, iterations, damping, seed), "walked")
    take = lambda w, b: w.join(b.withColumnRenamed("source", "dst"), "dst").select(F.col("src").alias("source"), "node", (F.col("w") * F.col("score")).alias("score"))
    waits = materialize(weights.where("final").select("src", "dst", "w"), "waits")
    need = materialize(waits.groupBy("src").agg(F.count("*").alias("need")), "need")
    # what a node has so far: itself and the walk baskets of successors that come later
    own = graph.vertices.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("score"))
    begun = materialize(own.union(take(weights.where("not final"), walked)).groupBy("source", "node").agg(F.sum("score").alias("score")), "begun")
    ready = graph.vertices.select(F.col("id").alias("source")).join(need.select(F.col("src").alias("source")), "source", "left_anti")
    level = materialize(keep_top(begun.join(ready, "source"), L), "level")
    final, pending = _Parts("final"), None
    while True:
        final.add(level)
        come = waits.join(level.select(F.col("source").alias("dst")).distinct(), "dst").groupBy("src").agg(F.count("*").alias("got"))
        come = come if pending is None else come.union(pending).groupBy("src").agg(F.sum("got").alias("got"))
        come = materialize(come.join(need, "src"), "come")
        ready = come.where("got = need").select("src")
        if ready.isEmpty():
            break
        rows = begun.join(ready.withColumnRenamed("src", "source"), "source").select("source", "node", "score").union(take(waits.join(ready, "src"), final.all()))
        level = materialize(keep_top(rows.groupBy("source", "node").agg(F.sum("score").alias("score")), L), "level")
        before, pending = pending, materialize(come.where("got < need").select("src", "got"), "pending")
        discard([come, *([before] if before is not None else [])])
    return keep_top(final.all(), K)
