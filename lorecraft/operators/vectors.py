"""A store of text vectors under commits: what is missing is embedded in small batches, what is stale goes.

Entries are (id, text). A stored row is valid for an entry if model and text are the same and the
vector has the model's dimension and only finite numbers. Embedding runs in tasks, a batch of
texts at a time; each commit has a name, so a micro-batch or a job that is run again adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecraft.operators.rules import HashedBigrams
from lorecraft.sources import commits

#: Texts that a model gets at once.
BATCH = 8
COLUMNS = "model string, text string, vector array<double>, batch_rows int"


def stored(spark: SparkSession, path: str, id_kind: str = "long") -> DataFrame:
    """The live rows (id, model, text, vector, batch_rows); none before the first commit."""
    if not commits.version(spark, path):
        return spark.createDataFrame([], f"id {id_kind}, {COLUMNS}")
    return commits.read(spark, path, "rows", ["id"])


def valid(rows: DataFrame, embedding) -> DataFrame:
    """Rows that the model may use: its own, of its dimension, finite throughout."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.col("model") == embedding.fingerprint) & (F.size("vector") == embedding.dimensions) & finite)


def missing(entries: DataFrame, rows: DataFrame, embedding) -> DataFrame:
    """Entries without a valid row for their text; of entries that repeat an id, one."""
    return entries.filter("text IS NOT NULL").dropDuplicates(["id"]).join(valid(rows, embedding).select("id", "text"), ["id", "text"], "left_anti")


def embedded(entries: DataFrame, embedding, size: int = BATCH) -> DataFrame:
    """(id, model, text, vector, batch_rows) of entries(id, text), `size` texts to a call of the model.

    Only the last call of a partition gets fewer. A vector of another length or with a number
    that isn't finite fails the job, so no part of such a batch is stored.
    """
    def call(part: pd.DataFrame) -> pd.DataFrame:
        vectors = embedding.embed(part["text"].tolist())
        if len(vectors) != len(part) or any(len(v) != embedding.dimensions or not all(abs(x) < float("inf") for x in v) for v in vectors):
            raise ValueError(f"{embedding.fingerprint} gave vectors of another shape")
        return pd.DataFrame({"id": part["id"], "model": embedding.fingerprint, "text": part["text"], "vector": vectors, "batch_rows": len(part)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for part in parts:
            part = part if left is None else pd.concat([left, part], ignore_index=True)
            whole = len(part) // size * size
            for at in range(0, whole, size):
                yield call(part.iloc[at : at + size])
            left = part.iloc[whole:]
        if left is not None and len(left):
            yield call(left)

    kind = entries.schema["id"].dataType.simpleString()
    return entries.select("id", "text").mapInPandas(run, f"id {kind}, {COLUMNS}")


def fill(spark: SparkSession, path: str, entries: DataFrame, change: str, embedding=None) -> int:
    """Embeds what the store lacks of entries and commits it under the change's name."""
    model = embedding or HashedBigrams()
    kind = entries.schema["id"].dataType.simpleString()
    rows = embedded(missing(entries, stored(spark, path, kind), model), model)
    # rows of one commit are in the store once by their ids, so the keys come from the entries, not from a second run of the model
    keys = missing(entries, stored(spark, path, kind), model).select("id").distinct().withColumn("deleted", F.lit(False))
    return commits.commit(spark, path, change, {"rows": rows}, keys)


def prune(spark: SparkSession, path: str, entries: DataFrame, change: str, embedding=None) -> int:
    """Removes rows whose entry is gone or has another text, and those of other models."""
    model = embedding or HashedBigrams()
    rows = stored(spark, path, entries.schema["id"].dataType.simpleString())
    live = rows.filter(F.col("model") == model.fingerprint).join(entries.select("id", "text"), ["id", "text"], "left_semi").select("id")
    gone = rows.select("id").join(live, "id", "left_anti").distinct()
    return commits.upsert(spark, path, change, rows.limit(0), ["id"], removed=gone)


def fill_from(stream: DataFrame, path: str, name: str, checkpoint: str, embedding=None) -> None:
    """Embeds what a stream of entries(id, text) brings, a commit for each micro-batch, until what is there is done.

    A micro-batch that is run again has the name of its first run and changes nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        fill(batch.sparkSession, path, batch, f"{name} {number}", embedding)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
