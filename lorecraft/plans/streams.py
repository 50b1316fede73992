"""Streaming queries: the events table as a stream, drained with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import vectors as V
from lorecraft.plans.registry import Registry
from lorecraft.plans.review import _STREAK, NOW_MS
from lorecraft.sources import commits
from lorecraft.sources.shared import drained, fresh_path
from lorecraft.streaming import streams as S

query = Registry()


def answers(spark, d):
    """The answers as a stream of the events table's files."""
    schema = B.table(spark, d, "events").schema
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("learner"), (k % 10).alias("unit"), k.alias("exercise"),
        F.col("event_type").isin("purchase", "signup", "view").alias("correct"), (F.col("event_type") == "view").alias("hint_used"),
        F.col("ts").cast("timestamp").alias("answered_at"), F.expr("unix_millis(cast(ts AS timestamp))").alias("ms"), F.col("value").alias("duration"), "event_type",
    )


@query("ST1_idempotent_ingest", "SELECT event_id AS id, user_id AS learner FROM events")
def st1(spark, d):
    twice = answers(spark, d).withColumn("copy", F.explode(F.when(F.col("id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return drained(S.ingested(twice, ["learner", "id"]), "ingest").select("id", "learner")


@query("ST2_running_mastery", _STREAK + """, sc AS (SELECT learner, unit, arg_max(interval_days, (ms, id)) AS interval_days FROM sched GROUP BY ALL)
SELECT m.learner, m.unit, review_count, correct_count, no_hint_correct_count, consecutive_no_hint_correct, exercise_count, last_reviewed_ms, sc.interval_days::INTEGER AS interval_days, last_reviewed_ms + sc.interval_days * 86400000::BIGINT AS due_ms, 0::BIGINT AS late FROM mast m JOIN sc USING (learner, unit)""")
def st2(spark, d):
    """The answers in five files, each with answers of all times: later files hold answers older than those before."""
    rv, path = B.review_events(spark, d), fresh_path(spark, "answers")
    rv.withColumn("answered_at", F.col("answered_at").cast("timestamp")).repartition(5, F.xxhash64("id")).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    states = drained(S.running_mastery(stream), "mastery", "update")
    names = ["review_count", "correct_count", "no_hint_correct_count", "consecutive_no_hint_correct", "exercise_count", "last_reviewed_ms", "interval_days", "due_ms", "late"]
    return states.groupBy("learner", "unit").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("learner", "unit", "s.*")


@query("ST3_daily_goals", "SELECT user_id AS learner, CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR) AS day, count(*) AS answered FROM events GROUP BY ALL")
def st3(spark, d):
    counts = drained(S.daily_goals(answers(spark, d)), "days", "update")
    return counts.groupBy("learner", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.max_by("answered", "batch").alias("answered"))


@query("ST5_run_metrics", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS status, count(*) AS runs, round(sum(value), 2) AS duration FROM events GROUP BY ALL")
def st5(spark, d):
    hours = drained(S.run_metrics(answers(spark, d)), "hours", "update")
    last = hours.groupBy("hour", "status").agg(F.max_by(F.struct("runs", "duration"), "batch").alias("s"))
    return last.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "status", "s.*")


@query("ST6_recent_only", f"SELECT event_id AS id, user_id AS learner FROM events WHERE epoch_us(ts) // 1000 >= {NOW_MS} - 10 * 86400000::BIGINT")
def st6(spark, d):
    return drained(S.recent_only(answers(spark, d), NOW_MS, 10).select("id", "learner"), "recent").select("id", "learner")


@query("ST4_embedding_queue", "SELECT doc_id AS id, 64 AS dimensions, 1 AS rows, true AS in_batches FROM documents WHERE text IS NOT NULL")
def st4(spark, d):
    """Every document embedded once, in batches of eight, by a stream that runs twice: the second time nothing is missing."""
    docs, path = B.documents(spark, d), fresh_path(spark, "vectors")
    for run in ("first", "again"):
        stream = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parquet*").select(F.col("doc_id").alias("id"), "text")
        V.fill_from(stream, path, run, fresh_path(spark, "checkpoint"))
    told = V.stored(spark, path).withColumn("dimensions", F.size("vector"))
    return told.groupBy("id", "dimensions").agg(F.count("*").cast("int").alias("rows"), F.bool_and(F.col("batch_rows").between(1, V.BATCH)).alias("in_batches"))


@query("RT21_vector_store", """SELECT doc_id AS id, 64 AS dimensions, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS sha, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS embedded_in FROM documents WHERE doc_id % 17 <> 0 AND text IS NOT NULL""")
def rt21_store(spark, d):
    """The store after a change of every tenth text and the removal of every seventeenth: only what changed was embedded again."""
    own, path = B.documents(spark, d).select(F.col("doc_id").alias("id"), "text"), fresh_path(spark, "vectors")
    V.fill(spark, path, own, "all")
    later = own.filter("id % 17 <> 0").withColumn("text", F.when(F.col("id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    V.fill(spark, path, later, "changes")
    V.fill(spark, path, later, "changes")
    V.prune(spark, path, later, "prune")
    first = commits.read(spark, path, "rows", ["id"], at=1).select("id", F.col("text").alias("_first"))
    told = V.stored(spark, path).join(first, "id")
    return told.select("id", F.size("vector").alias("dimensions"), F.sha2("text", 256).alias("sha"), F.when(F.col("text") == F.col("_first"), 1).otherwise(2).alias("embedded_in"))
