"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, ``[\x20\x09-\x0D]``, as characters.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A key that holds more than one row in this many is resolved by a broadcast of so few rows.
HEAVY_KEYS = 1000
#: Spark's setting that removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that ``stored`` has written inside each ``settled`` that is under way.
_WRITTEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent (tests in local mode) a temporary folder of this
    machine is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/lorecraft/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict) -> Iterator[None]:
    """Settings of the session for the actions inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors.

    The shuffle files of the write are removed as soon as it is committed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    with settings(spark, {SHUFFLE_CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders, through the file system that Spark writes them with."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(*tables: DataFrame | None) -> None:
    """Removes the files of tables made by ``stored`` that no later step reads."""
    for df in tables:
        if df is not None:
            remove(df.sparkSession, sorted({f.rpartition("/")[0] for f in df.inputFiles()}))


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """build() stored, and every other table that was stored for it removed, also where it fails."""
    _WRITTEN.append([])
    kept = None
    try:
        out = stored(build(), name)
        kept = _WRITTEN[-1].pop()
    finally:
        remove(spark, _WRITTEN.pop())
        # inside another settled, what is kept here is on the way there
        if kept and _WRITTEN:
            _WRITTEN[-1].append(kept)
    return out


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(c, UPPER, LOWER)


def heavy_rows(table: DataFrame, weight: str, total: int) -> DataFrame:
    """The rows of table (one for each key) whose weight is a HEAVY_KEYS-th of total or more.

    As the weights sum to total at most, these are HEAVY_KEYS rows at most: safe to broadcast.
    """
    return table.filter(F.col(weight) * HEAVY_KEYS >= total)


def join_heavy(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of rows to table on key, where single keys may hold a large share of rows.

    table has one row for each key; weight tells how many of the total rows have that key.
    Its heavy rows are broadcast, which covers any key that holds a thousandth of all rows;
    the others meet in a shuffled join, where no key is large. Null keys get null columns.
    """
    names = [c for c in table.columns if c != key]
    first = rows.join(F.broadcast(heavy_rows(table, weight, total).withColumn("_hit", F.lit(1))), key, "left")
    # rows that are served already get join keys that no row of the table has, so they spread out
    spread = F.when(F.col("_hit") == 1, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(4096))).otherwise(F.lit(0))
    light = table.select(key, F.lit(0).cast("long").alias("_spread"), *[F.col(c).alias(f"_light_{c}") for c in names])
    both = first.withColumn("_spread", spread.cast("long")).join(light, [key, "_spread"], "left")
    return both.select(*rows.columns, *[F.coalesce(F.col(c), F.col(f"_light_{c}")).alias(c) for c in names])
