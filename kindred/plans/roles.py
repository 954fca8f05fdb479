"""The star-schema tables in the roles of a labelled collection.

A cell is an order, a gene a part with its name as symbol, a count the quantity of a part in an order, a sample a customer, a
study a nation, a tissue a market segment, a disease an order priority. Term graphs and labelled vectors come with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.matrix import collapsed
from kindred.sources.tables import load


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Counts whose coordinates may repeat: enough for what only sums them, and a shuffle less."""
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_idx"), F.col("l_quantity").alias("value"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(lines(spark, d))


def genes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").alias("gene_idx"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("brand"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation, region = (load(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(
        F.col("o_orderkey").alias("cell_id"),
        F.col("c_custkey").alias("sample"),
        F.col("n_name").alias("study"),
        F.col("c_mktsegment").alias("tissue"),
        F.col("o_orderpriority").alias("disease"),
        F.col("o_orderstatus").alias("data_type"),
        F.col("r_name").alias("region"),
        F.col("o_totalprice").alias("price"),
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").alias("query_id"), "vector")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A graph with several parents a node: n div 2 and n div 3 above n."""
    key = load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("child"))
    both = key.select(F.expr("child div 2").cast("int").alias("parent"), "child").union(key.select(F.expr("child div 3").cast("int").alias("parent"), "child"))
    return both.where("child > 0").distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("node"))


#: The same, for the SQL of the catalogue.
COUNTS = "counts AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_idx, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2)"
GENES = "genes AS (SELECT p_partkey AS gene_idx, p_name AS symbol, p_brand AS brand FROM part)"
CELLS = (
    "cells AS (SELECT o_orderkey AS cell_id, c_custkey AS sample, n_name AS study, c_mktsegment AS tissue, o_orderpriority AS disease, "
    "o_orderstatus AS data_type, r_name AS region, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)
VECTORS = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings)"
DISTANCES = f"{VECTORS}, distances AS (SELECT q.id AS query_id, r.id AS id, r.label AS label, list_cosine_distance(q.vector, r.vector) AS dist FROM vectors q, vectors r)"
RANKED = f"{DISTANCES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM distances)"
EDGES = "edges AS (SELECT DISTINCT (n_nationkey // k)::INT AS parent, n_nationkey::INT AS child FROM nation, (VALUES (2), (3)) t(k) WHERE n_nationkey > 0)"
CLOSURE = (
    f"{EDGES}, walk AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM edges UNION SELECT w.ancestor, e.child, w.depth + 1 FROM walk w JOIN edges e ON w.descendant = e.parent), "
    "pairs AS (SELECT ancestor, descendant, min(depth)::INT AS depth FROM walk GROUP BY 1, 2)"
)
