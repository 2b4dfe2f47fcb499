"""Queries of the library over the test tables, and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Views that stand in for the domain's tables: the same text for both engines, but for literals.
VIEWS = {
    "psi_points": "SELECT c_custkey AS ps_id, CAST((c_custkey*7919)%10007 AS DOUBLE) AS x, CAST((c_custkey*104729)%10009 AS DOUBLE) AS y, c_acctbal/100 AS z, (c_acctbal-4500)/1500 AS mean_vel, c_nationkey/25.0D AS var_mean_vel FROM customer",
    "psi_series": "SELECT user_id AS ps_id, event_type AS direction, ts, value FROM events",
    "sites": "SELECT s_suppkey AS grp, CAST((s_suppkey*7919)%10007 AS DOUBLE) AS cx, CAST((s_suppkey*104729)%10009 AS DOUBLE) AS cy, CAST(50+s_nationkey*10 AS DOUBLE) AS half FROM supplier",
    "raster": "SELECT 0 AS tile, CAST(floor(p_partkey/50.0D) AS BIGINT) AS r, p_partkey%50 AS c, p_retailprice-1000 - 0.5D*(p_partkey%400)+150 AS v FROM part",
    "features": "SELECT l_orderkey*10+l_linenumber AS fid, l_returnflag AS fclass, l_linestatus AS ref, l_shipdate AS seen, CAST((l_partkey*7919)%10007 AS DOUBLE) AS x, CAST((l_suppkey*104729+l_orderkey*31)%10009 AS DOUBLE) AS y, l_quantity AS len, l_extendedprice AS area FROM lineitem",
    "catalogue": "SELECT o_orderkey AS id, o_orderdate AS t, o_totalprice/100000 AS magnitude, o_orderpriority AS kind FROM orders",
    "labels3": "SELECT doc_id AS id, doc_id % 97 AS grp, CASE WHEN quality = 1 THEN 'slide' ELSE 'sinkhole' END AS class_1, CASE WHEN toxic = 1 THEN 'rockfall' END AS class_2, CASE doc_id % 3 WHEN 0 THEN 'subsidence' WHEN 1 THEN 'slide' END AS class_3, doc_id % 5 = 0 AS known, 'c' || CAST(doc_id % 11 AS VARCHAR(9)) AS comment FROM labels",
}
_TABLE_OF = {"psi_points": "customer", "psi_series": "events", "sites": "supplier", "raster": "part", "features": "lineitem", "catalogue": "orders", "labels3": "labels"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view, or a table as it is."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table = _TABLE_OF[name]
    return spark.sql(VIEWS[name].replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def views_sql() -> str:
    return ", ".join(f"{k} AS ({v.replace('.0D', '.0').replace('0.5D', '0.5')})" for k, v in VIEWS.items())


def query(name: str, sql: str | None = None, *tables: str):
    """Register a query: its function gets the named tables, its SQL (a body after the views' WITH, or with its own CTEs after 'WITH') the same."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, t) for t in tables])
        QUERIES[name].__name__ = name
        if sql:
            body = sql.strip()
            ORACLE[name] = f"WITH {views_sql()}" + (", " + body[4:] if body.startswith("WITH") else " " + body)
        return f

    return add
