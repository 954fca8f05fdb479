"""Scans, gathers, writes and compaction of Parquet tables, and text side tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.sources.shared import settled


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(df: DataFrame, condition: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows for which a predicate such as ``x > 5 and y != "b"`` holds, projected; rows with a null or a NUL-string in a projected column go."""
    out = df.where(condition) if condition else df
    out = out.select(*columns) if columns else out
    strings = [c for c, kind in out.dtypes if kind == "string"]
    return out.withColumns({c: F.when(F.col(c) != "\x00", F.col(c)) for c in strings}).na.drop("any")


def gather(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``ids`` (pos, key) in ``df``, with ``pos``, the caller's order. A repeated id comes as often as asked; one that is absent not at all."""
    return ids.select("pos", key).join(df, key)


def positions(spark: SparkSession, ids: list, key: str, kind: str = "long") -> DataFrame:
    """A caller's list of ids as (pos, key)."""
    return spark.createDataFrame([(list(ids),)], f"ids array<{kind}>").select(F.posexplode("ids").alias("pos", key))


def with_row_ids(df: DataFrame, order: str | list[str], first: int = 0, name: str = "row_id") -> DataFrame:
    """Consecutive ids in the order of columns, by counts of range partitions and not by one sort of all rows in one task."""
    by = [order] if isinstance(order, str) else list(order)
    spread = settled(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1 + first
    return spread.withColumn("_n", place).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_n") + F.col("_start")).cast("long")).drop("_part", "_n", "_start")


def append(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose ``key`` counts from 0, moved behind those at ``path``; returns by how much. The columns must be those at ``path``."""
    spark = df.sparkSession
    offset = 0
    if _exists(spark, path):
        old = spark.read.parquet(path)
        if set(old.columns) != set(df.columns):
            raise ValueError(f"the table at {path} has the columns {sorted(old.columns)}, not {sorted(df.columns)}")
        last = old.agg(F.max(key)).first()[0]
        offset = 0 if last is None else last + 1
    df.withColumn(key, F.col(key) + F.lit(offset)).write.mode("append").parquet(path)
    return offset


def write_at(df: DataFrame, path: str, key: str, first: int) -> None:
    """Writes rows whose ``key`` counts from 0 to the table at ``path``, from the place ``first`` on. Raises ValueError if any of those places is taken."""
    spark = df.sparkSession
    ends = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    if ends["a"] is None:
        return
    if _exists(spark, path) and spark.read.parquet(path).where(F.col(key).between(first + ends["a"], first + ends["b"])).take(1):
        raise ValueError(f"rows {first + ends['a']} to {first + ends['b']} of the table at {path} aren't free")
    df.withColumn(key, F.col(key) + F.lit(first)).write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, by: str | None = None) -> None:
    """Puts ``df``, which may read the table at ``path``, in that table's place; ``by`` names a column to make folders of.

    Everything is written beside the table first, so what fails before leaves the table as it was; then the folders change names, and the old one goes.
    """
    spark, new, old = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:12]}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:12]}"
    name = spark._jvm.org.apache.hadoop.fs.Path
    system = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(new)
    except Exception:
        system.delete(name(new), True)
        raise
    if system.exists(name(path)) and not system.rename(name(path), name(old)):
        raise OSError(f"the table at {path} can't be moved")
    if not system.rename(name(new), name(path)):
        system.rename(name(old), name(path))
        raise OSError(f"the new table can't be moved to {path}")
    system.delete(name(old), True)
    spark.catalog.refreshByPath(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a published table that were written to their end, oldest first."""
    return sorted(n for n, done in _published(spark, path) if done)


def publish(df: DataFrame, path: str) -> int:
    """Writes ``df``, which may read an earlier one, as the next version of the table at ``path``; returns its number. Readers of earlier versions go on; one that isn't written to its end is never read."""
    n = 1 + max((n for n, _ in _published(df.sparkSession, path)), default=0)
    df.write.parquet(f"{path}/version-{n}")
    return n


def published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a published table, the newest by default; it stays as it is until it is vacuumed."""
    known = versions(spark, path)
    if version is None and known:
        version = known[-1]
    if version not in known:
        raise ValueError(f"the table at {path} has the versions {known}")
    return spark.read.parquet(f"{path}/version-{version}")


def consolidate(spark: SparkSession, path: str, key: str, files: int) -> int:
    """Publishes the newest version again, as ``files`` sorted ranges of a key."""
    return publish(published(spark, path).repartitionByRange(files, key).sortWithinPartitions(key), path)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Deletes all but the newest ``keep`` versions, and what was never written to its end before them; returns what is left."""
    if keep < 1:
        raise ValueError("a table keeps one version at least")
    left = versions(spark, path)[-keep:]
    name = spark._jvm.org.apache.hadoop.fs.Path
    system = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n, _ in _published(spark, path):
        if left and n < left[0]:
            system.delete(name(f"{path}/version-{n}"), True)
    return left


def write_clustered(df: DataFrame, path: str, key: str, span: int) -> None:
    """Writes a table in folders of ``span`` consecutive keys each, for gathers that open only the folders they need."""
    df.withColumn("_range", F.floor(F.col(key) / span)).repartition("_range").sortWithinPartitions(key).write.mode("overwrite").partitionBy("_range").parquet(path)


def gather_clustered(spark: SparkSession, path: str, ids: DataFrame, key: str, span: int, most: int = 10_000) -> DataFrame:
    """``gather`` from a table that ``write_clustered`` made: only the ids' own folders are read, unless they are more than ``most``."""
    own = ids.select(F.floor(F.col(key) / span).alias("_range")).where("_range is not null").distinct()
    wanted = [r["_range"] for r in own.limit(most + 1).collect()]
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("_range").isin(wanted)) if len(wanted) <= most else rows
    return gather(rows.drop("_range"), ids, key)


def append_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def compact(spark: SparkSession, source: str, target: str | None, key: str, files: int, rows_per_file: int = 0) -> None:
    """Rewrites many small files as ``files`` ranges of a key, sorted, of at most ``rows_per_file`` rows each if given; without a ``target`` in place, by ``replace``."""
    df = spark.read.parquet(source).repartitionByRange(files, key).sortWithinPartitions(key)
    if target is None:
        return replace(df, source)
    df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(target)


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, value)`` of a text file of one value a line, such as a gene order. One file, read as a whole: these are short."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("pos", "value"))


def separated(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=header, schema=schema)


def study_samples(spark: SparkSession, root: str) -> DataFrame:
    """Tables below ``study=.../sample=...`` folders as one."""
    return spark.read.option("basePath", root).parquet(root)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _published(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Numbers of all versions that were begun, and whether each was written to its end."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    system = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(name(path)):
        return []
    begun = [s.getPath().getName() for s in system.listStatus(name(path))]
    return [(int(n.removeprefix("version-")), system.exists(name(f"{path}/{n}/_SUCCESS"))) for n in begun if n.startswith("version-")]
