"""The folder that driver and executors share, and streams that run over what lies there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder of this machine only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/lorecraft-core/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


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


def written(table: DataFrame, name: str) -> DataFrame:
    """table written to the shared folder and read again; the shuffle files of the write go when it is committed."""
    spark = table.sparkSession
    path = fresh_path(spark, name)
    with settings(spark, {SHUFFLE_CLEANUP: "true"}):
        table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Removes the files of tables made by `written` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in sorted({f.rpartition("/")[0] for f in table.inputFiles()}):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives over what is there now: each micro-batch is written as Parquet with its number, then read."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/out")
