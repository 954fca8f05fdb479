"""Ontologies in OBO text as term and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``terms`` (term_id, name) and ``edges`` (parent, child), each once; obsolete terms go.

    A term's parents are its ``is_a`` lines and the targets of its ``relationship`` lines. Stanzas are split by Spark,
    so a large file is read in pieces.
    """
    stanzas = spark.read.option("lineSep", "\n\n").text(path).select(F.split(F.trim("value"), r"\r?\n").alias("lines")).where(F.array_contains("lines", "[Term]"))
    live = stanzas.where(~F.exists("lines", lambda x: x.startswith("is_obsolete: true"))).withColumn("_id", F.try_element_at(F.filter("lines", lambda x: x.startswith("id: ")), F.lit(1)))
    live = live.withColumn("_name", F.try_element_at(F.filter("lines", lambda x: x.startswith("name: ")), F.lit(1))).where("_id is not null")
    term = F.trim(F.substring("_id", 5, 1 << 20))
    terms = live.select(term.alias("term_id"), F.trim(F.substring("_name", 7, 1 << 20)).alias("name")).dropDuplicates(["term_id"])
    line = live.select(term.alias("child"), F.explode("lines").alias("line")).withColumn("line", F.trim(F.split("line", " ! ")[0]))
    kind = F.when(F.col("line").startswith("is_a: "), F.trim(F.substring("line", 7, 1 << 20))).when(F.col("line").startswith("relationship: "), F.split("line", r"\s+")[2])
    edges = line.withColumn("parent", F.split(kind, r"\s")[0]).where("parent is not null").select("parent", "child").distinct()
    return terms, edges.join(terms.select(F.col("term_id").alias("parent")), "parent", "left_semi").select("parent", "child")
