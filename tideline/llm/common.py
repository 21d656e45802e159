"""Helpers shared by the training-data operators: staging, skew-proof lookups, batches."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the largest groups that a lookup join broadcasts; every other group
#: then holds at most a thousandth of all rows.
HOT_GROUPS = 1000

#: Words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that a Python task takes up at a time; a single longer row is a portion of its own.
PORTION_ROWS, PORTION_BYTES = 512, 8 << 20
#: Bytes of a batch between Spark and Python.
BATCH_BYTES = 4 << 20


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or a folder in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base.rstrip("/") if base else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tideline/{uuid.uuid4().hex}-{name}"


_scratch = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside are deleted at its end, unless they are to be kept."""
    before, _scratch.paths = getattr(_scratch, "paths", None), []
    try:
        yield
    finally:
        own, _scratch.paths = _scratch.paths, before
        if own:
            remove(SparkSession.active(), *own)


def stage(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without computing df again.
    """
    spark = session_of(df)
    path = stage_path(spark, name)
    if not keep and getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in dfs:
        remove(session_of(df), *{f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tideline/" in f})


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders of any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, unless the session has them smaller: the one setting that operators change.

    Batches are made when a result is written, so the bound has to stand in the
    session.  Executors keep buffers of a batch's size for each column and task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"\d+", spark.conf.get(name))
    if not now or not 0 < int(now[0]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def portions(batches: Iterator[pa.RecordBatch], rows: int = PORTION_ROWS, size: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, of so few rows and bytes that what Python makes of them stays small.

    Spark's batches are bounded by bounded_batches().
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow holds of those before goes back to the system, since workers live on for later stages."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def beside(df: DataFrame, *new: T.StructField) -> T.StructType:
    """The schema of _row, a struct of all columns of df, and new columns; names of the two don't clash."""
    return T.StructType([T.StructField("_row", df.schema, False), *new])


def unfolded(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """The columns of _row, and the new ones; one of df that has the name of a new one goes first as that name with _in behind."""
    taken, out = {*old, *new}, []
    for c in old:
        name = c
        while name in new or name != c and name in taken:
            name += "_in"
        taken.add(name)
        out.append(F.col(f"_row.`{c}`").alias(name))
    return df.select(*out, *new)


def dealt_groups(rows: DataFrame, group: str) -> DataFrame:
    """Every group of rows and _task, the task that it is dealt to: as many groups to each, one more at most.

    By hash some tasks get several groups and others none.  ``rows`` should be staged,
    since its groups are listed here.  Only a number a partition of that list is
    summed across the whole.  repartitionById() takes _task.
    """
    spark = session_of(rows)
    place = F.monotonically_increasing_id()
    listed = stage(rows.select(group).distinct().select(group, F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "dealt")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = listed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.join(parts, "_part").select(group, F.pmod(F.col("_at") + F.col("_before"), F.lit(tasks)).cast("int").alias("_task"))


def lookup_join(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, *, also: tuple[str, ...] = (), found: bool = False) -> DataFrame:
    """Join of rows with groups (one row per key, and the columns ``also``) that stands hot keys; a left join, or an inner one if ``found``.

    The HOT_GROUPS largest groups by ``size`` are broadcast; their rows don't
    enter the shuffle on the key, where every other group is below a thousandth
    of all rows.  ``groups`` should be staged, since it is read twice.  ``key`` is a
    string or a long; ``spread`` (a long, never null) deals out the rows of hot
    groups and of null keys.
    """
    value = [c for c in groups.columns if c not in (key, *also)]
    top = groups.orderBy(F.desc(size), key, *also).limit(HOT_GROUPS)
    hot = top.select(key, *also, F.struct(*value).alias("_hot"))
    marked = rows.join(F.broadcast(hot), [key, *also], "left")
    # a dealt-out row that meets some group by chance keeps its hot one
    away = spread if dict(groups.dtypes)[key] == "bigint" else F.concat(F.lit("\x00"), spread.cast("string"))
    marked = marked.withColumn("_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(away))
    cold = groups.select(F.col(key).alias("_key"), *also, F.struct(*value).alias("_cold"))
    joined = marked.join(cold, ["_key", *also], "left")
    if found:
        joined = joined.filter("_hot is not null or _cold is not null")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in value))


def by_id(docs: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on doc_id, "left" or "left_anti", of documents of which many may have a null one: those don't enter the shuffle."""
    joined = docs.filter("doc_id is not null").join(right, "doc_id", how)
    return joined.unionByName(docs.filter("doc_id is null"), allowMissingColumns=True)
