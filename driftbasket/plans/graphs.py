"""Graphs in the driver's tables: the same SQL runs on Spark and on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph

_PURCHASES = "select user_id as src, lead(user_id) over (order by ts, event_id) as dst from events where event_type = 'purchase'"
_TRADE = (
    "select distinct cast(s.s_nationkey as bigint) as src, cast(c.c_nationkey as bigint) as dst from lineitem l join orders o on l.l_orderkey = o.o_orderkey "
    "join customer c on o.o_custkey = c.c_custkey join supplier s on l.l_suppkey = s.s_suppkey"
)
EDGES = {
    "flow": f"select distinct src, dst from ({_PURCHASES}) where dst is not null",
    "flow_multi": f"select src, dst from ({_PURCHASES}) where dst is not null",
    "tree": "select cast(c_custkey + 1000000 as bigint) as src, cast(c_nationkey + 1000 as bigint) as dst from customer union all select cast(n_nationkey + 1000 as bigint), cast(n_regionkey as bigint) from nation",
    "bipartite": "select distinct cast(l_partkey + 100000 as bigint) as src, cast(l_suppkey as bigint) as dst from lineitem",
    "trade": _TRADE,
    "trade_sparse": f"{_TRADE} where l_returnflag = 'R' and l_quantity >= 49 and c_mktsegment = 'BUILDING' and o_orderpriority like '1%'",
}
TABLES = {"flow": ["events"], "flow_multi": ["events"], "tree": ["customer", "nation"], "bipartite": ["lineitem"], "trade": ["lineitem", "orders", "customer", "supplier"]}


def edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name.removesuffix("_sparse")]}
    sql = EDGES[name]
    for t in views:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t} ", f"join {{{t}}} ")
    return spark.sql(sql, **views)


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    from ..scratch import materialize

    return Graph.from_edges(materialize(edges(spark, sf_dir, name), name))
