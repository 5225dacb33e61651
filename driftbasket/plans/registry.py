"""The registered graph queries and their SQL for DuckDB.

Scores are compared as whole millionths: sums of doubles in another order differ in the last bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import jaccard, kendall_tau_b, norm1
from ..graph import Graph
from ..operators.baskets import baskets, half_sweep, initial
from ..operators.exact import exact_multi_source, exact_single_source
from ..operators.partition import find_partitions
from ..operators.quality_report import benchmark_report, sample_sources
from ..operators.topk import keep_top
from ..operators.walks import degree_order, monte_carlo, queue_order, walk_baskets, walk_trace
from ..scratch import materialize, scratch_root
from ..sources.edge_csv import read_edge_csv
from .graphs import EDGES, edges, graph

Query = Callable[[SparkSession, str], DataFrame]
D, K, L, SWEEPS = 0.85, 10, 20, 10
TOLERANCE, MOST_SWEEPS = 0.05, 16
SAMPLE, SEED = 200, "report"  # the report's own default
WALKS = 40


def e6(score: Column) -> Column:
    return F.floor(score * 1e6 + 0.500001).cast("long")


def _scored(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, e6(F.col("score")).alias("score_e6"))


def _e6(x: str) -> str:
    return f"cast(floor({x} * 1e6 + 0.500001) as bigint)"


def _top(rows: str, most: int) -> str:
    return f"select source, node, score from ({rows}) qualify row_number() over (partition by source order by floor(score * 1e10 + 0.501) desc, node) <= {most}"


def _with(name: str, *more: str) -> str:
    base = [f"e as materialized ({EDGES[name]})", "v as materialized (select src as id from e union select dst from e)", "o as (select src, count(*) as n from e group by src)"]
    base.append(f"w as materialized (select e.src, e.dst, count(*) * {D} / o.n as w from e join o on e.src = o.src group by e.src, e.dst, o.n)")
    return "with recursive " + ",\n".join([*base, *more]) + "\n"


_INIT = "b0 as materialized (" + _top(f"select source, node, sum(score) as score from (select id as source, id as node, {1 - D:.10f} as score from v union all select src, dst, w from w) group by source, node", L) + ")"
_SIDES = [
    "u as materialized (select src as a, dst as b from e union select dst, src from e)",
    "far(id, dist) as (select min(id), 0 from v union select u.b, far.dist + 1 from far join u on u.a = far.id where far.dist < 8)",
    "sides as materialized (select id, min(dist) % 2 as side from far group by id)",
]


def _sweep(k: int) -> str:
    """The CTE of half-sweep k = 1, 2, ..."""
    side = (k - 1) % 2
    rows = f"select s.id as source, s.id as node, {1 - D:.10f} as score from sides s where s.side = {side} union all select w.src, b.node, w.w * b.score from w join sides s on s.id = w.src and s.side = {side} join b{k - 1} b on b.source = w.dst"
    summed = f"select source, node, sum(score) as score from ({rows}) group by source, node"
    return f"b{k} as materialized ({_top(summed, L)} union all select b.source, b.node, b.score from b{k - 1} b join sides s on s.id = b.source where s.side <> {side})"


def _basket_sql(n: int = SWEEPS) -> list[str]:
    return [*_SIDES, _INIT, *(_sweep(k) for k in range(1, n + 1)), f"baskets as materialized ({_top(f'select * from b{n}', K)})"]


def _exact(sources: str, steps: int, tolerance: float | None = None) -> list[str]:
    """x(source, node, score): after `steps` steps, or for each source after the first step that moves it by less."""
    out = [
        f"src(source) as materialized ({sources})",
        f"""x_all(source, node, score, i) as (select source, source, cast(1 as double), 0 from src union all
          select source, node, sum(score), i from (select x.source, w.dst as node, x.score * w.w as score, x.i + 1 as i from x_all x join w on w.src = x.node where x.i < {steps}
          union all select distinct x.source, x.source, {1 - D:.10f}, x.i + 1 from x_all x where x.i < {steps}) group by source, node, i)""",
    ]
    if tolerance is None:
        return [*out, f"x as (select source, node, score from x_all where i = {steps})"]
    return [
        *out,
        "moved as (select source, i, sum(abs(d)) as d from (select source, node, i, sum(s) as d from (select source, node, i, score as s from x_all where i > 0 union all select source, node, i + 1, -score from x_all) group by source, node, i) group by source, i)",
        f"stop as (select s.source, coalesce(min(m.i), {steps}) as i from src s left join moved m on m.source = s.source and m.i <= {steps} and m.d < {tolerance} group by s.source)",
        "x as materialized (select a.source, a.node, a.score from x_all a join stop s on s.source = a.source and s.i = a.i)",
    ]


def _kendall(pairs: str) -> list[str]:
    return [
        f"pr as materialized ({pairs})",
        """kn as (select s.source, case when c.nx is null then 1.0 when c.nx * c.ny = 0 then (case when c.nx = c.ny then 1.0 else 0.0 end) else c.num / sqrt(c.nx * c.ny) end as kendall
          from (select distinct source from pr) s left join (select a.source, sum(sign(a.x - b.x) * sign(a.y - b.y)) as num, sum(abs(sign(a.x - b.x))) as nx, sum(abs(sign(a.y - b.y))) as ny
          from pr a join pr b on a.source = b.source and a.item < b.item group by a.source) c on c.source = s.source)""",
    ]


def _report_sql(strict: bool) -> str:
    of = "select distinct source from baskets" + (" where source in (select src from e)" if strict else "")
    sample = f"select source from ({of}) order by md5('{SEED}:' || source), source limit {SAMPLE}"
    more = [
        *_exact(sample, 100, 1e-4),
        "own as materialized (select b.* from baskets b join src using (source))",
        "sz as (select source, count(*) as size from own group by source)",
        "tp as (select source, node from (select x.*, row_number() over (partition by source order by floor(score * 1e10 + 0.501) desc, node) as k from x) r join sz using (source) where k <= size)",
        "jc as (select sz.source, sz.size, i.n / (sz.size + t.n - i.n) as jaccard from sz join (select source, count(*) as n from tp group by source) t using (source) join (select own.source, count(tp.node) as n from own left join tp on tp.source = own.source and tp.node = own.node group by own.source) i using (source))",
        *_kendall("select own.source, own.node as item, floor(own.score * 1e10 + 0.501) as x, floor(coalesce(x.score, 0) * 1e10 + 0.501) as y from own left join x on x.source = own.source and x.node = own.node"),
    ]
    return _with("flow", *_basket_sql(), *more) + f"select {_e6('avg(jaccard)')} as jaccard_average, {_e6('min(jaccard)')} as jaccard_min, {_e6('avg(kendall)')} as kendall_average, {_e6('min(kendall)')} as kendall_min, {_e6('avg(size)')} as average_map_size from jc join kn using (source)"


def _report(spark: SparkSession, d: str, strict: bool, sample: int = SAMPLE) -> DataFrame:
    g = graph(spark, d, "flow")
    out = benchmark_report(baskets(g, K, L, SWEEPS, D), g, sample, strict, SEED)
    return out.select(*(e6(F.col(c)).alias(c) for c in out.columns))


_ALL = "select id as source from v"
_PRNG = "cast(('0x' || substr(md5('walk:' || source || ':' || walk || ':' || (step + 1) || ':{}'), 1, 8)) as bigint) / 4294967296.0"
_WALK = [
    f"src(source) as materialized ({_ALL})",
    "k as materialized (select src, dst, row_number() over (partition by src order by dst) as k, count(*) over (partition by src) as n from e)",
    f"""t(source, walk, step, node) as (select s.source, g.walk, 1, k.dst from src s cross join range({int(WALKS * D)}) g(walk) join k on k.src = s.source and k.k = (g.walk + 1) % k.n + 1
      union all select t.source, t.walk, t.step + 1, k.dst from t join k on k.src = t.node and k.k = cast(floor({_PRNG.format('hop')} * k.n) as bigint) + 1 where {_PRNG.format('stay')} <= {D})""",
]


def _sources(g: Graph) -> DataFrame:
    return g.vertices.select(F.col("id").alias("source"))


def _long(df: DataFrame, **to: str) -> DataFrame:
    return df.select(*(F.col(a).cast("long").alias(b) for b, a in to.items()))


def _list(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


_RETURNED = "select cast(l_partkey + 100000 as bigint) as source, cast(l_suppkey as bigint) as node, sum(l_quantity) / 1000 as score from lineitem where l_returnflag = 'R' group by l_partkey, l_suppkey"


def _baskets_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two sparse vectors per part: its suppliers by weight, and those that got it back by quantity."""
    a = graph(spark, d, "bipartite").weights(D).select(F.col("src").alias("source"), F.col("dst").alias("node"), F.col("w").alias("score"))
    return a, spark.sql(_RETURNED.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))


_PAIR = ["a as (select src as source, dst as node, w as score from w)", f"b as ({_RETURNED})"]
_DEGENERATE = "(1, 1, 1, 1), (1, 2, 1, 2), (2, 1, 1, 2), (2, 2, 1, 2), (3, 1, 5, 7), (4, 1, 1, 3), (4, 2, 2, 2), (4, 3, 3, 1), (5, 1, 1, 1), (5, 2, 1, 2), (5, 3, 2, 2)"


#: Nations before regions unless these have more links; the customers of a nation as soon as it has come.
_ORDER_TREE = _with("tree").rstrip() + """, r as (select id, row_number() over (order by coalesce(i.n, 0) desc, coalesce(o.n, 0), id) as r from v left join (select dst, count(*) as n from e group by dst) i on i.dst = id left join o on o.src = id),
    n as (select e.src as id, least(a.r, b.r) as q, case when a.r < b.r then 0 else 1 end as d from e join r a on a.id = e.src join r b on b.id = e.dst where e.src < 1000000),
    p as (select id, q, d, id as after from n union all select e.src, n.q, n.d + 1, n.id from e join n on n.id = e.dst union all select id, r, 0, id from r where id not in (select src from e))
    select id, row_number() over (order by q, d, after, id) - 1 as ord from p"""
_MC_TREE = f"""with r as (select id as source, id as node, 1.0::double as score from (select c_custkey + 1000000 as id from customer union select c_nationkey + 1000 from customer union select n_nationkey + 1000 from nation union select n_regionkey from nation)
    union all select c_custkey + 1000000, c_nationkey + 1000, {D} from customer union all select n_nationkey + 1000, n_regionkey, {D} from nation
    union all select c_custkey + 1000000, n_regionkey, {D * D:.10f} from customer join nation on n_nationkey = c_nationkey)
    select cast(source as bigint) as source, cast(node as bigint) as node, {_e6('score')} as score_e6 from r"""


def edge_file(spark: SparkSession, d: str) -> DataFrame:
    """The edges of `flow` written as lines of text, with repeats, and read as an edge file."""
    path = f"{scratch_root(spark)}/edges-{uuid.uuid4().hex}"
    edges(spark, d, "flow_multi").select(F.concat_ws(", ", "src", "dst").alias("value")).write.text(path)
    return _long(read_edge_csv(spark, path).edges, src="src", dst="dst")


def _registry() -> dict[str, tuple[Query, str | None]]:
    g = lambda s, d, n="flow": graph(s, d, n)
    q: dict[str, tuple[Query, str | None]] = {}
    q["edges_distinct"] = (lambda s, d: edges(s, d, "flow_multi").dropDuplicates(["src", "dst"]), f"select distinct src, dst from ({EDGES['flow_multi']})")
    q["vertex_closure"] = (lambda s, d: g(s, d, "tree").vertices.select("id"), _with("tree") + "select id from v")
    q["graph_stats"] = (
        lambda s, d: (x := g(s, d, "flow_multi")).vertices.agg(F.count("*").alias("nodes")).join(x.edges.agg(F.count("*").alias("edges"), F.count_distinct("src", "dst").alias("distinct_edges")), how="inner", on=F.lit(True)),
        _with("flow_multi") + "select (select count(*) from v) as nodes, (select count(*) from e) as edges, (select count(*) from (select distinct * from e)) as distinct_edges",
    )
    q["degrees_in_out"] = (lambda s, d: g(s, d, "flow_multi").degrees(), _with("flow_multi") + "select id, coalesce(i.n, 0) as indegree, coalesce(o.n, 0) as outdegree from v left join (select dst, count(*) as n from e group by dst) i on i.dst = id left join o on o.src = id")
    q["predecessor_lists"] = (lambda s, d: g(s, d, "flow_multi").predecessors().select("id", _list("predecessors").alias("predecessors")), _with("flow_multi") + "select dst as id, string_agg(src, ',' order by src) as predecessors from e group by dst")
    q["successor_lists"] = (lambda s, d: g(s, d, "flow_multi").successors().select("id", _list("successors").alias("successors")), _with("flow_multi") + "select src as id, string_agg(dst, ',' order by dst) as successors from e group by src")
    q["dangling_nodes"] = (lambda s, d: g(s, d, "bipartite").dangling(), _with("bipartite") + "select id from v where id not in (select src from e)")
    q["transition_weights"] = (lambda s, d: g(s, d, "flow_multi").weights(D).select("src", "dst", e6(F.col("w")).alias("w_e6")), _with("flow_multi") + f"select src, dst, {_e6('w')} as w_e6 from w")
    q["keep_top_per_source"] = (lambda s, d: _scored(keep_top(_baskets_pair(s, d)[1], 5), "source", "node"), _with("bipartite", *_PAIR) + f"select source, node, {_e6('score')} as score_e6 from ({_top('select * from b', 5)})")
    q["keep_top_short_baskets"] = (lambda s, d: _scored(keep_top(_baskets_pair(s, d)[0], 10_000), "source", "node"), _with("bipartite", *_PAIR) + f"select source, node, {_e6('score')} as score_e6 from a")
    q["norm1_pairs"] = (lambda s, d: norm1(*_baskets_pair(s, d)).select("source", e6(F.col("norm1")).alias("norm1_e6")), _with("bipartite", *_PAIR) + f"select source, {_e6('sum(abs(coalesce(a.score, 0) - coalesce(b.score, 0)))')} as norm1_e6 from a full join b using (source, node) group by source")

    def jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
        a, b = (x.groupBy("source").agg(F.collect_set("node").alias(n)) for x, n in zip(_baskets_pair(s, d), "ab", strict=True))
        return a.join(b, "source", "full").select("source", e6(jaccard(F.coalesce("a", F.array().cast("array<bigint>")), F.coalesce("b", F.array().cast("array<bigint>")))).alias("jaccard_e6"))

    jaccard_sql = _with("bipartite", *_PAIR) + f"select source, {_e6('count(a.node + b.node) / count(*)')} as jaccard_e6 from a full join b using (source, node) group by source"
    jaccard_sql = jaccard_sql.replace("from a full join b using (source, node)", "from (select coalesce(a.source, b.source) as source, a.node as an, b.node as bn from a full join b on a.source = b.source and a.node = b.node)").replace("count(a.node + b.node)", "count(an + bn)")
    q["jaccard_pairs"] = (jaccard_pairs, jaccard_sql)

    def kendall(s: SparkSession, d: str) -> DataFrame:
        e = edges(s, d, "flow")
        pairs = e.select(F.col("src").alias("source"), F.col("dst").alias("item"), (F.col("dst") % 7).alias("x"), (F.col("dst") % 5).alias("y"))
        return kendall_tau_b(pairs).select("source", e6(F.col("kendall")).alias("kendall_e6"))

    q["kendall_tau_b"] = (kendall, _with("flow", *_kendall("select src as source, dst as item, dst % 7 as x, dst % 5 as y from e")) + f"select source, {_e6('kendall')} as kendall_e6 from kn")
    degenerate = lambda s, d: kendall_tau_b(s.sql(f"select cast(col1 as bigint) as source, col2 as item, col3 as x, col4 as y from values {_DEGENERATE}")).select("source", e6(F.col("kendall")).alias("kendall_e6"))
    q["kendall_degenerate"] = (degenerate, "with " + ", ".join(_kendall(f"select cast(source as bigint) as source, item, x, y from (values {_DEGENERATE}) t(source, item, x, y)")) + f" select source, {_e6('kendall')} as kendall_e6 from kn")
    least = lambda x: x.vertices.agg(F.min("id")).first()[0]
    one = "select min(id) from v"
    q["exact_single_fixed"] = (lambda s, d: _scored(exact_single_source(x := g(s, d), least(x), 15, D, -1.0), "node"), _with("flow", *_exact(one, 15)) + f"select node, {_e6('score')} as score_e6 from x")
    q["exact_single_converged"] = (lambda s, d: _scored(exact_single_source(x := g(s, d), least(x), 60, D, 0.02), "node"), _with("flow", *_exact(one, 60, 0.02)) + f"select node, {_e6('score')} as score_e6 from x")

    def dangling_loss(s: SparkSession, d: str) -> DataFrame:
        x = g(s, d, "tree")
        customers = x.vertices.where("id >= 1000000").select(F.col("id").alias("source"))
        return _scored(exact_multi_source(x, customers, 10, D, 1e-4), "source", "node")

    q["exact_dangling_loss"] = (
        dangling_loss,
        f"""with c as (select c_custkey + 1000000 as source, c_nationkey from customer), r as (select source, source as node, {1 - D:.10f} as score from c
        union all select source, c_nationkey + 1000, {(1 - D) * D:.10f} from c union all select source, n_regionkey, {(1 - D) * D * D:.10f} from c join nation on n_nationkey = c_nationkey)
        select source, cast(node as bigint) as node, {_e6('score')} as score_e6 from r""",
    )
    q["exact_multi_source"] = (lambda s, d: _scored(exact_multi_source(x := g(s, d), _sources(x), 12, D, -1.0), "source", "node"), _with("flow", *_exact(_ALL, 12)) + f"select source, node, {_e6('score')} as score_e6 from x")
    q["bfs_partition"] = (lambda s, d: _long(find_partitions(g(s, d)), id="id", side="side"), _with("flow", *_SIDES) + "select id, cast(side as bigint) as side from sides")
    q["partition_sizes"] = (lambda s, d: find_partitions(g(s, d)).groupBy(F.col("side").cast("long").alias("side")).agg(F.count("*").alias("nodes")), _with("flow", *_SIDES) + "select cast(side as bigint) as side, count(*) as nodes from sides group by side")
    q["basket_init"] = (lambda s, d: _scored(initial(g(s, d), L, D), "source", "node"), _with("flow", _INIT) + f"select source, node, {_e6('score')} as score_e6 from b0")

    def one_sweep(s: SparkSession, d: str) -> DataFrame:
        x = g(s, d)
        sides = find_partitions(x)
        weights = x.weights(D).join(sides.withColumnRenamed("id", "src"), "src")
        return _scored(half_sweep(initial(x, L, D), weights, sides, 0, L, D), "source", "node")

    q["basket_half_sweep"] = (one_sweep, _with("flow", *_SIDES, _INIT, _sweep(1)) + f"select b.source, b.node, {_e6('b.score')} as score_e6 from b1 b join sides s on s.id = b.source where s.side = 0")
    fixed = _with("flow", *_basket_sql()) + f"select source, node, {_e6('score')} as score_e6 from baskets"
    q["basket_fixed"] = (lambda s, d: _scored(baskets(g(s, d), K, L, SWEEPS, D), "source", "node"), fixed)

    def converged(s: SparkSession, d: str) -> DataFrame:
        report: dict = {}
        out = baskets(g(s, d), K, L, MOST_SWEEPS, D, TOLERANCE, report=report)
        return _scored(out, "source", "node").withColumn("half_sweeps", F.lit(report["half_sweeps"]).cast("long"))

    diff = lambda k: f"select {k} as i, max(d) as d from (select source, sum(abs(s)) as d from (select source, node, sum(score) as s from (select source, node, score from b{k} union all select source, node, -score from b{k - 1}) group by source, node) group by source)"
    steps = [
        f"moved as materialized ({' union all '.join(diff(k) for k in range(1, MOST_SWEEPS + 1))})",
        f"h as (select least(coalesce(min(a.i), {MOST_SWEEPS}), {MOST_SWEEPS}) as n from moved a join moved b on b.i = a.i - 1 where a.d < {TOLERANCE} and b.d < {TOLERANCE})",
        f"last as ({' union all '.join(f'select b.*, h.n from b{k} b join h on h.n = {k}' for k in range(1, MOST_SWEEPS + 1))})",
    ]
    q["basket_converged"] = (converged, _with("flow", *_basket_sql(MOST_SWEEPS)[:-1], *steps) + f"select t.source, t.node, {_e6('t.score')} as score_e6, cast(h.n as bigint) as half_sweeps from ({_top('select * from last', K)}) t cross join h")
    q["basket_parallel"] = (lambda s, d: _scored(baskets(g(s, d), K, L, SWEEPS, D, nThreads=4), "source", "node"), fixed)

    def error(s: SparkSession, d: str) -> DataFrame:
        x = g(s, d)
        b = materialize(baskets(x, K, L, SWEEPS, D), "baskets")
        t = exact_multi_source(x, _sources(x), 30, D, -1.0, wanted=b)
        both = b.join(t.withColumnRenamed("score", "exact"), ["source", "node"])
        return both.groupBy("source").agg(F.count("*").alias("nodes"), e6(F.sum(F.abs(F.col("score") - F.col("exact")))).alias("error_e6"))

    q["basket_vs_exact_error"] = (error, _with("flow", *_basket_sql(), *_exact(_ALL, 30)) + f"select x.source, count(*) as nodes, {_e6('sum(abs(b.score - x.score))')} as error_e6 from baskets b join x on x.source = b.source and x.node = b.node group by x.source")
    q["benchmark_report_all"] = (lambda s, d: _report(s, d, False), _report_sql(False))
    q["benchmark_report_strict"] = (lambda s, d: _report(s, d, True), _report_sql(True))
    empty = lambda s, d: benchmark_report(s.createDataFrame([], "source long, node long, score double"), g(s, d))
    q["benchmark_empty"] = (empty, "select -1.0::double as jaccard_average, -1.0::double as jaccard_min, -1.0::double as kendall_average, -1.0::double as kendall_min, -1.0::double as average_map_size")
    picked = lambda s, d: sample_sources((x := g(s, d, "tree")).vertices.select(F.col("id").alias("source")), x, SAMPLE, True, SEED)
    q["benchmark_sample"] = (picked, _with("tree") + f"select id as source from v where id in (select src from e) order by md5('{SEED}:' || id), id limit {SAMPLE}")
    q["exec_order_rank"] = (lambda s, d: _long(degree_order(g(s, d, "bipartite")), id="id", ord="ord"), _with("bipartite") + "select id, row_number() over (order by coalesce(i.n, 0) desc, coalesce(o.n, 0), id) - 1 as ord from v left join (select dst, count(*) as n from e group by dst) i on i.dst = id left join o on o.src = id")
    q["exec_order_full"] = (lambda s, d: queue_order(g(s, d)), None)
    q["walk_trace"] = (lambda s, d: _long(walk_trace(x := g(s, d), _sources(x), WALKS, D), source="source", walk="walk", step="step", node="node"), _with("flow", *_WALK) + "select source, cast(walk as bigint) as walk, cast(step as bigint) as step, node from t")
    seen = f"select source, node, sum(n) as n, min(f) as f from (select source, source as node, {WALKS} as n, -1000000 as f from src union all select source, node, count(*), min(walk * 1000 + step) from t group by source, node) group by source, node"
    q["walk_scores"] = (lambda s, d: _scored(walk_baskets(x := g(s, d), _sources(x), 30, WALKS, D), "source", "node"), _with("flow", *_WALK) + f"select source, node, {_e6(f'n / {WALKS}')} as score_e6 from ({seen}) qualify row_number() over (partition by source order by f) <= 30")
    q["mc_baskets"] = (lambda s, d: _scored(monte_carlo(g(s, d), K, L, WALKS, D), "source", "node"), None)
    q["exec_order_tree"] = (lambda s, d: _long(queue_order(g(s, d, "tree")), id="id", ord="ord"), _ORDER_TREE)
    q["mc_baskets_tree"] = (lambda s, d: _scored(monte_carlo(g(s, d, "tree"), K, L, WALKS, D), "source", "node"), _MC_TREE)
    q["import_edge_file"] = (edge_file, f"select distinct cast(src as bigint) as src, cast(dst as bigint) as dst from ({EDGES['flow_multi']})")
    return q


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _registry().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _registry().items() if s}
