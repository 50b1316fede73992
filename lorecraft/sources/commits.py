"""Tables that are changed by commits: staged writes, one pointer for each version, readers that see whole versions.

A commit writes the rows of the keys that it changes into a folder of its own, then moves a small
manifest to the name of the next version, which must not exist yet: that move is the commit. A
writer that dies before leaves nothing that anyone reads, two writers of one version get one
winner, and a change that is repeated under its name is found among the manifests and not made
again. A key's rows are those of the last version that has the key; a removed key is a row of the
version's keys that says so. A base version holds everything, so readers need no older one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorecraft.sources.shared import SHUFFLE_CLEANUP, settings


class Conflict(Exception):
    """Another writer has made this version; read again and work the change out anew."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """What has been committed, in order: version, change, folder, base."""
    folder = _path(spark, f"{path}/_versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    out = []
    for status in fs.listStatus(folder):
        if status.getPath().getName().isdigit():
            stream = fs.open(status.getPath())
            out.append(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return sorted(out, key=lambda m: m["version"])


def version(spark: SparkSession, path: str) -> int:
    """The last committed version, 0 where there is none."""
    return max((m["version"] for m in manifests(spark, path)), default=0)


def commit(spark: SparkSession, path: str, change: str, tables: dict[str, DataFrame | Callable], keys: DataFrame, expected: int | None = None, base: bool = False) -> int:
    """The version that holds a change, made now or before.

    tables maps a name to the rows of the changed keys, or to a function that makes them of the
    tables before it, as they are read back; keys has every changed key and deleted (boolean). With `expected`, a table that has another version by now is a Conflict before
    anything is written.
    """
    told = manifests(spark, path)
    done = next((m["version"] for m in told if m["change"] == change), None)
    if done is not None:
        return done
    last = told[-1]["version"] if told else 0
    if expected is not None and expected != last:
        raise Conflict(f"version {last} instead of {expected}")
    number, folder = last + 1, f"{path}/data/{uuid.uuid4().hex}"
    made = {}
    # the shuffle files of a write go when it is committed
    with settings(spark, {SHUFFLE_CLEANUP: "true"}):
        for name, rows in (tables | {"_keys": keys}).items():
            rows = rows(made) if callable(rows) else rows
            rows.withColumn("_version", F.lit(number)).write.option("compression", "zstd").parquet(f"{folder}/{name}")
            made[name] = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
    put(spark, path, {"version": number, "change": change, "folder": folder, "base": base})
    return number


def put(spark: SparkSession, path: str, manifest: dict) -> None:
    """Commits a manifest under its version's name, unless that exists."""
    jvm = spark._jvm
    staged, target = _path(spark, f"{path}/_versions/_{uuid.uuid4().hex}"), _path(spark, f"{path}/_versions/{manifest['version']:010d}")
    fs = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(staged, False)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        # without an option to overwrite, the move fails where the name is taken
        files.rename(staged, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(staged, False)
        raise Conflict(f"version {manifest['version']} is taken") from e


def based(spark: SparkSession, path: str, at: int | None = None) -> list[dict]:
    """The commits that a version (the last one by default) is made of, from its base on."""
    told = [m for m in manifests(spark, path) if at is None or m["version"] <= at]
    if not told:
        raise FileNotFoundError(f"nothing is committed in {path}")
    return told[max((k for k, m in enumerate(told) if m["base"]), default=0) :]


def every(spark: SparkSession, path: str, name: str, at: int | None = None) -> DataFrame:
    """All rows of a table with their _version, also those that later commits replaced."""
    return spark.read.parquet(*[f"{m['folder']}/{name}" for m in based(spark, path, at)])


def holding(spark: SparkSession, path: str, key: list[str], at: int | None = None) -> DataFrame:
    """(key, _version): the version that has the rows of each key that is there."""
    last = every(spark, path, "_keys", at).groupBy(*key).agg(F.max_by("deleted", "_version").alias("_deleted"), F.max("_version").alias("_version"))
    return last.filter(~F.col("_deleted")).drop("_deleted")


def read(spark: SparkSession, path: str, name: str, key: list[str], at: int | None = None) -> DataFrame:
    """The rows of a table as of a version (the last one by default)."""
    rows = every(spark, path, name, at)
    if len(based(spark, path, at)) == 1:
        return rows.drop("_version")
    return rows.join(holding(spark, path, key, at), [*key, "_version"], "left_semi").drop("_version")


def upsert(spark: SparkSession, path: str, change: str, rows: DataFrame, key: list[str], removed: DataFrame | None = None, expected: int | None = None) -> int:
    """Puts rows in place of those with their keys and removes the keys of `removed`; a key in both is removed.

    Of rows that repeat a key, all stay. Keys must not be null.
    """
    kept = rows if removed is None else rows.join(removed.select(*key), key, "left_anti")
    keys = kept.select(*key).distinct().withColumn("deleted", F.lit(False))
    if removed is not None:
        keys = keys.unionByName(removed.select(*key).distinct().withColumn("deleted", F.lit(True)))
    return commit(spark, path, change, {"rows": kept}, keys, expected)


def compacted(spark: SparkSession, path: str, names: list[str], key: list[str]) -> int:
    """Makes a base version of what is live; the change is named by the version that it holds."""
    at = version(spark, path)
    tables = {name: read(spark, path, name, key, at) for name in names}
    keys = tables[names[0]].select(*key).distinct().withColumn("deleted", F.lit(False))
    return commit(spark, path, f"base of {at}", tables, keys, at, base=True)


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
