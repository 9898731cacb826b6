"""Registering queries, and the SQL of the role views for their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.roles import CANONICAL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ITEMS = """items AS (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS t,
 CAST(l_quantity AS DECIMAL(6,0)) AS q, CAST(year(l_shipdate) AS INT) AS yr FROM lineitem)"""
WIDE = ITEMS + """, wide AS (SELECT l_suppkey AS entity_id, yr, COUNT(*) AS n, MAX(l_shipdate) AS created_at,
 {} FROM items GROUP BY ALL)""".format(", ".join(f"CAST(SUM(CAST({e} AS DECIMAL(20,4))) AS DECIMAL(20,4)) AS {name}" for name, _, e in CANONICAL))  # fmt: skip
FACTS = WIDE + ", facts AS ({})".format(" UNION ALL ".join(
    f"SELECT entity_id, 'FY' || yr AS period, '{name}' AS canonical_name, {name} AS value, CAST(50 + (n * 7 + {k} * 11) % 50 AS DOUBLE) / 100 AS confidence, '{cat}' AS category, created_at, {k} AS k, yr FROM wide WHERE (entity_id * 31 + yr * 17 + {k} * 7) % 11 <> 0"
    for k, (name, cat, _) in enumerate(CANONICAL)
))
ENTITIES = """entities AS (SELECT s_suppkey AS entity_id, s_name AS name, r_name AS industry, n_name AS nation, n_nationkey % 12 + 1 AS fiscal_year_end,
 ['USD','EUR','GBP','JPY','CHF'][r_regionkey + 1] AS currency FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_custkey AS entity_id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(14,2)) AS cost, o_orderpriority AS grade, o_orderdate AS created_at FROM orders)"
RAW = ITEMS + """, raw AS (SELECT l_suppkey AS entity_id, l_returnflag || '_' || l_linestatus AS canonical_name, 'FY' || yr AS period, p AS value,
 CAST(d * 5 + 0.5 AS DOUBLE) AS confidence, l_shipdate AS created_at, l_orderkey AS seq_1, l_linenumber AS seq_2, l_partkey AS seq_3 FROM items)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n"


def dbl(x: str, scale: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(30,10)), {scale}) AS DOUBLE)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function by its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
