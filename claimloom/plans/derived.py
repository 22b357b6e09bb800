"""A knowledge graph derived from the star-schema tables, by the same rules in Spark and in SQL.

Nodes are regions, nations, customers, suppliers and parts; edges say where they are and which
supplier supplies which part. Ids are arithmetic on keys, so no global order is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SQL = """
SELECT 1000000000 + CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'REGION' AS classification, CAST(NULL AS VARCHAR) AS description, CAST(r_regionkey AS BIGINT) AS k FROM region
UNION ALL SELECT 2000000000 + CAST(n_nationkey AS BIGINT), n_name, 'NATION', CAST(NULL AS VARCHAR), CAST(n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT 3000000000 + c_custkey, c_name, 'CUSTOMER', c_mktsegment, c_custkey FROM customer
UNION ALL SELECT 4000000000 + s_suppkey, s_name, 'SUPPLIER', CAST(NULL AS VARCHAR), s_suppkey FROM supplier
UNION ALL SELECT 5000000000 + p_partkey, p_name || '#' || CAST(p_partkey AS VARCHAR), 'PART', p_type, p_partkey FROM part
"""

EDGE_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS id, 2000000000 + CAST(n_nationkey AS BIGINT) AS source, 1000000000 + CAST(n_regionkey AS BIGINT) AS target, 'LOCATED_IN' AS relation FROM nation
UNION ALL SELECT 1000000000000 + c_custkey, 3000000000 + c_custkey, 2000000000 + CAST(c_nationkey AS BIGINT), 'LOCATED_IN' FROM customer
UNION ALL SELECT 2000000000000 + s_suppkey, 4000000000 + s_suppkey, 2000000000 + CAST(s_nationkey AS BIGINT), 'LOCATED_IN' FROM supplier
UNION ALL SELECT DISTINCT 1000000000000000000 + l_suppkey * 10000000000 + l_partkey, 4000000000 + l_suppkey, 5000000000 + l_partkey, 'SUPPLIES' FROM lineitem
"""

#: For SQL equivalents: put in front of a query on nodes and edges.
GRAPH_CTE = f"WITH RECURSIVE nodes AS ({NODE_SQL}), edges AS ({EDGE_SQL})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, classification, description, k)."""
    parts = (
        ("region", 1, "r_regionkey", F.col("r_name"), "REGION", F.lit(None)),
        ("nation", 2, "n_nationkey", F.col("n_name"), "NATION", F.lit(None)),
        ("customer", 3, "c_custkey", F.col("c_name"), "CUSTOMER", F.col("c_mktsegment")),
        ("supplier", 4, "s_suppkey", F.col("s_name"), "SUPPLIER", F.lit(None)),
        ("part", 5, "p_partkey", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")), "PART", F.col("p_type")),
    )
    out = None
    for name, kind, key, label, classification, description in parts:
        k = F.col(key).cast("bigint")
        one = table(spark, sf_dir, name).select((F.lit(kind * 1_000_000_000) + k).alias("id"), label.alias("name"), F.lit(classification).alias("classification"), description.cast("string").alias("description"), k.alias("k"))
        out = one if out is None else out.unionByName(one)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, target, relation), directed, without parallel edges."""
    located = (("nation", 0, 2, "n_nationkey", 1, "n_regionkey"), ("customer", 10**12, 3, "c_custkey", 2, "c_nationkey"), ("supplier", 2 * 10**12, 4, "s_suppkey", 2, "s_nationkey"))
    out = None
    for name, base, a, key, b, other in located:
        s, t = F.col(key).cast("bigint"), F.col(other).cast("bigint")
        one = table(spark, sf_dir, name).select((F.lit(base) + s).alias("id"), (F.lit(a * 1_000_000_000) + s).alias("source"), (F.lit(b * 1_000_000_000) + t).alias("target"), F.lit("LOCATED_IN").alias("relation"))
        out = one if out is None else out.unionByName(one)
    supplied = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return out.unionByName(supplied.select((F.lit(10**18) + F.col("l_suppkey") * 10**10 + F.col("l_partkey")).alias("id"), (F.lit(4_000_000_000) + F.col("l_suppkey")).alias("source"), (F.lit(5_000_000_000) + F.col("l_partkey")).alias("target"), F.lit("SUPPLIES").alias("relation")))
