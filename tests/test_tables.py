"""Writes that take places, replace and compact; gathers that open few files; genes by studies."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kindred.operators import matrix, training
from kindred.sources import tables


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_writing_at_a_place(spark, tmp_path):
    path = str(tmp_path / "t")
    three = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row long, x string")
    tables.write_at(three, path, "row", 4)
    tables.write_at(three.where("row = 0"), path, "row", 0)
    assert rows(spark.read.parquet(path)) == [(0, "a"), (4, "a"), (5, "b"), (6, "c")]
    for first in (2, 4, 6):
        with pytest.raises(ValueError):
            tables.write_at(three, path, "row", first)
    tables.write_at(three.where("false"), path, "row", 4)
    assert spark.read.parquet(path).count() == 4


def test_replacing_keeps_the_old_table_if_a_task_fails(spark, tmp_path):
    path = str(tmp_path / "m")
    first = spark.createDataFrame([(0, 0, 1.0), (1, 2, 5.0)], "cell_id long, gene_idx int, value double")
    matrix.overwrite_matrix(first, path, (2, 3))
    bad = first.withColumn("value", F.when(F.col("cell_id") == 1, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        matrix.overwrite_matrix(bad, path, (2, 3))
    assert rows(spark.read.parquet(path)) == rows(first)
    for shape in ((1, 3), (2, 2)):
        with pytest.raises(ValueError):
            matrix.overwrite_matrix(first, path, shape)
    # the new table may be made of the old one
    matrix.overwrite_matrix(spark.read.parquet(path).withColumn("value", F.col("value") * 2), path, (2, 3))
    assert rows(spark.read.parquet(path)) == [(0, 0, 2.0), (1, 2, 10.0)] and [p.name for p in tmp_path.iterdir()] == ["m"]
    matrix.overwrite_matrix(first.where("false"), path, (2, 3))
    assert spark.read.parquet(path).count() == 0


def test_compaction_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(6):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(path)
    assert len(list(Path(path).glob("*.parquet"))) == 6
    tables.compact(spark, path, None, "id", 2)
    assert len(list(Path(path).glob("*.parquet"))) == 2 and spark.read.parquet(path).count() == 60 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.versions(spark, path) == []
    with pytest.raises(ValueError):
        tables.published(spark, path)
    assert tables.publish(spark.range(20).repartition(5), path) == 1
    reader = tables.published(spark, path)
    # a version that fails is never read, and its number isn't used again
    with pytest.raises(Exception, match="lost"):
        tables.publish(spark.range(9).select(F.when(F.col("id") > 5, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id")), path)
    assert tables.versions(spark, path) == [1] and tables.published(spark, path).count() == 20
    assert tables.publish(tables.published(spark, path).union(spark.range(20, 25)), path) > 1
    last = tables.consolidate(spark, path, "id", 2)
    assert len(list(Path(f"{path}/version-{last}").glob("*.parquet"))) == 2
    assert rows(tables.published(spark, path)) == [(i,) for i in range(25)] and reader.count() == 20 and tables.published(spark, path, 1).count() == 20
    assert tables.vacuum(spark, path, 2) == tables.versions(spark, path)[-2:] and 1 not in tables.versions(spark, path)
    assert tables.vacuum(spark, path) == [last] and [p.name for p in Path(path).iterdir() if p.is_dir()] == [f"version-{last}"]
    with pytest.raises(ValueError):
        tables.published(spark, path, 1)


def scanned(df):
    """Files that the scans of an executed plan opened."""
    df.collect()
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            stack.append(node.plan())
            continue
        if "Scan parquet" in name:
            total += node.metrics().apply("numFiles").value()
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_gathers_open_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_clustered(spark.range(10_000).withColumn("x", F.col("id") * 2), path, "id", 100)
    ids = tables.positions(spark, [905, 17, 950, 17, 99_999], "id")
    got = tables.gather_clustered(spark, path, ids, "id", 100)
    assert rows(got.select("pos", "id", "x")) == [(0, 905, 1810), (1, 17, 34), (2, 950, 1900), (3, 17, 34)]
    assert scanned(got) == 2
    many = tables.gather_clustered(spark, path, ids, "id", 100, most=1)
    assert rows(many.select("pos", "id", "x")) == rows(got.select("pos", "id", "x")) and scanned(many) == 100


def test_genes_by_studies(spark):
    samples = spark.createDataFrame([("s1", 5, "A, B,C"), ("s1", 9, "A,B"), ("s2", 1, "B,,D"), ("s3", 2, None), (None, 99, "Z")], "study string, n int, genes string")
    chosen = training.chosen_samples(samples, "n")
    assert {r.study: r.n for r in chosen.collect()} == {"s1": 9, "s2": 1, "s3": 2} and chosen.columns == samples.columns
    listed = training.listed_genes(chosen)
    assert rows(training.gene_studies(listed)) == [("A", 1), ("B", 2), ("D", 1)] and rows(training.gene_studies(listed, 2)) == [("B", 2)]
