"""Shared folder, materialised intermediate tables and stable hashing for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: An intermediate table has so many files a core, or one for so many shuffle partitions, whichever is more; and no more than its data have partitions.
FILES_A_CORE, PARTITIONS_A_FILE = 2, 3


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master, as in tests, may leave it unset, and then gets a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(context, "_kindred_dir", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="kindred-")
            context._kindred_dir = folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def deleted(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def _made(spark: SparkSession) -> tuple[list[str], list[str]]:
    """Folders and tables that operators made in this session and that are still there."""
    context = spark.sparkContext
    if not hasattr(context, "_kindred_made"):
        context._kindred_made = ([], [])
    return context._kindred_made


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate folders and tables that operators made inside. Results are lazy, so write what is wanted of them inside too."""
    marks = [len(x) for x in _made(spark)]
    try:
        yield
    finally:
        folders, tables = _made(spark)
        for table in tables[marks[1] :]:
            spark.sql(f"drop table if exists {table}")
        for folder in folders[marks[0] :]:
            deleted(spark, folder)
        del folders[marks[0] :], tables[marks[1] :]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made(spark)[0].append(path)
    return path


def new_table(spark: SparkSession, name: str) -> str:
    table = f"kindred_{name}_{uuid.uuid4().hex}"
    _made(spark)[1].append(table)
    return table


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    Of small partitions three go to one file, as small files cost more than they hold, but there are enough of them to keep all cores busy twice.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    files = max(FILES_A_CORE * spark.sparkContext.defaultParallelism, partitions(df) // PARTITIONS_A_FILE)
    df.coalesce(files).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is computed inside, as texts and their windows can be long; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if not 0 < int(own) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or as many underscores before it as it takes to clash with no column; Spark's names know no case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def order_text(key: Column) -> Column:
    """16 characters that sort as whole numbers do; null comes last."""
    return F.coalesce(F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("~" * 16))


def ordered_number(text: Column) -> Column:
    """The number that ``order_text`` made such a text of, which may go on behind its 16 characters."""
    signed = F.conv(F.substring(text, 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(~text.startswith("~"), signed)


def remainder(key: str | Column, modulus: int) -> Column:
    """``crc32(key as text) mod modulus``: the fold of a row."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def sampled(rows: DataFrame, group: str, most: int) -> DataFrame:
    """``rows`` of each group, about ``most`` of them: those whose hash of doc_id is below the bound that lets ``most`` pass; all of a smaller group.

    ``weight``: how many rows of its group each one stands for. Each row is judged by itself and its group's size, so no task
    gathers a group; ids are distinct within a group. Groups are the classes of a model, so their sizes are few and broadcast.
    """
    place, whole = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), float(1 << 40)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    below = rows.join(F.broadcast(sizes), group).where(place.cast("double") * F.col("_size") <= most * whole)
    return below.withColumn("weight", F.greatest(F.col("_size") / most, F.lit(1.0))).drop("_size")


def partitions(df: DataFrame) -> int:
    """The session's shuffle width."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
