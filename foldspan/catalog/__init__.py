"""Registered queries on the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldspan.session import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Operators of the survey that a query covers.
COVERS: dict[str, str] = {}


class Tables:
    """The tables of a folder, and the views that the queries share, as text that both engines read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = reachable(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, sql: str) -> DataFrame:
        """A view over one or more tables named in braces."""
        import re

        frames = {n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", sql))}
        return self.spark.sql(sql, **frames)


def query(covers: str, sql: str | None = None):
    def register(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        COVERS[name] = covers
        if sql:
            SQL[name] = sql
        return f

    return register


def plain(sql: str) -> str:
    """View text for an engine where the tables have their own names."""
    import re

    return re.sub(r"\{(\w+)\}", r"\1", sql)


#: An entity table in the shape of the reference: one row a customer, columns by whole-number formulas of the key.
COMPANY = """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS industry,
  CASE c_nationkey % 3 WHEN 0 THEN 'listed' WHEN 1 THEN 'private' END AS listing,
  CASE c_custkey % 4 WHEN 0 THEN 'BtoB' WHEN 1 THEN 'BtoC' WHEN 2 THEN 'BtoB, BtoC' END AS channel,
  CAST(c_custkey * 37 % 500 AS DOUBLE) AS employees, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 7 AS DOUBLE) END AS offices,
  CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 4 AS DOUBLE) END AS plants,
  CAST(c_custkey * 7919 % 1009 AS DOUBLE) AS sales, CASE WHEN c_custkey % 13 > 0 THEN c_acctbal END AS op_profit,
  CASE WHEN c_custkey % 11 > 0 THEN c_acctbal - 100e0 END AS ord_profit, c_acctbal * 0.5e0 AS net_profit,
  CAST(c_custkey * 6007 % 2011 AS DOUBLE) AS assets, CAST(c_custkey * 401 % 503 AS DOUBLE) AS equity, CAST(c_custkey * 103 % 401 AS DOUBLE) AS debt,
  c_acctbal - 1000e0 AS op_cf, CAST(-(c_custkey * 31 % 997) AS DOUBLE) AS inv_cf, CAST(-(c_custkey * 17 % 503) AS DOUBLE) AS software_chg,
  CAST(c_custkey % 301 AS DOUBLE) AS short_loans, CAST(c_custkey * 3 % 211 AS DOUBLE) AS long_loans,
  CAST(c_custkey * 7 % 809 AS DOUBLE) AS current_assets, CAST(c_custkey * 11 % 607 AS DOUBLE) AS net_assets,
  CAST(1 + c_custkey * 3 % 5 AS INT) AS q1, CAST(1 + c_custkey % 7 % 5 AS INT) AS q2, CAST(1 + c_custkey % 11 % 5 AS INT) AS q3,
  CAST(1 + c_custkey % 13 % 5 AS INT) AS q4, CAST(1 + c_custkey % 17 % 5 AS INT) AS q5, CAST(1 + c_custkey % 2 AS INT) AS q6,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(1 + c_custkey % 19 % 5 AS DOUBLE) END AS q7, CAST(1 + c_custkey % 23 % 5 AS INT) AS q8,
  CASE WHEN c_custkey % 29 > 0 THEN CAST(1 + c_custkey % 31 % 5 AS INT) END AS q9, CAST(1 + c_custkey % 37 % 5 AS INT) AS q10, CAST(1 + c_custkey % 41 % 5 AS INT) AS q11,
  CAST((c_custkey * 31 + c_nationkey * 7) % 100 < 30 + c_nationkey AS INT) AS y, CAST(c_custkey % 5 AS INT) AS fold
FROM {customer}
"""

#: Labels and three scores of the orders; scores have ties.
SCORES = """
SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS priority, CAST(o_orderkey % 5 AS INT) AS fold, CAST(o_orderstatus = 'F' AS INT) AS y,
  ((o_orderkey * 7919 + o_custkey * 31) % 997 + CASE WHEN o_orderstatus = 'F' THEN 300 ELSE 0 END + 0.5e0) / 1298e0 AS p1,
  ((o_orderkey * 613 + o_custkey * 17) % 499 + CASE WHEN o_orderstatus = 'F' THEN 90 ELSE 0 END + 0.5e0) / 590e0 AS p2,
  ((o_orderkey * 101 + o_custkey * 7) % 199 + CASE WHEN o_orderstatus = 'F' THEN 20 ELSE 0 END + 0.5e0) / 220e0 AS p3
FROM {orders}
"""

#: The same for three seeds.
SEEDED = """
SELECT s.seed, o_orderkey AS id, CAST(o_orderkey % 5 AS INT) AS fold, CAST(o_orderstatus = 'F' AS INT) AS y,
  ((o_orderkey * 7919 + o_custkey * 31 + s.seed * 613) % 997 + CASE WHEN o_orderstatus = 'F' THEN 300 ELSE 0 END + 0.5e0) / 1298e0 AS p1,
  ((o_orderkey * 613 + o_custkey * 17 + s.seed * 401) % 499 + CASE WHEN o_orderstatus = 'F' THEN 140 ELSE 0 END + 0.5e0) / 640e0 AS p2
FROM {orders} CROSS JOIN (SELECT 0 AS seed UNION ALL SELECT 1 UNION ALL SELECT 2) s
"""

#: Scores in the long form of the store.
PREDS = f"""
SELECT seed, 'a' AS model, id, p1 AS p FROM ({SEEDED}) x UNION ALL SELECT seed, 'b' AS model, id, p2 AS p FROM ({SEEDED}) z
"""

#: Documents with their labels.
LABELLED = """
SELECT d.doc_id AS id, d.text, d.lang, d.source, l.quality AS y FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""


def register_all() -> None:
    from foldspan.catalog import evaluation, exploration, features, folds, learning, texts  # noqa: F401
