"""How the general tables of a folder stand for the inputs of the operators.

Every view is deterministic, and the moment that counts as now is a literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"

#: The same views in SQL, to begin a query with.
RV_SQL = """WITH rv AS (
  SELECT event_id AS id, user_id AS learner, k % 10 AS unit, k AS exercise, event_type IN ('purchase', 'signup', 'view') AS correct,
    event_type = 'view' AS hint_used, ts AS answered_at, epoch_us(ts) // 1000 AS ms, value AS duration, event_type
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
)"""
RUNS_SQL = """WITH runs AS (
  SELECT event_id AS id, user_id, 'skill_' || CAST(k % 4 AS VARCHAR) AS skill, 'src_' || CAST(user_id % 2 AS VARCHAR) AS source, value AS duration_ms, ts AS created_at, k % 5 AS steps, k % 3 AS retries,
    k % 2 AS approvals, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'cancelled' ELSE 'running' END AS status,
    CASE WHEN event_type = 'error' THEN 'E' || CAST(k % 7 AS VARCHAR) END AS error_code
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: id, learner, unit, exercise, correct, hint_used, answered_at, ms, duration, event_type."""
    return _keyed(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("learner"), (F.col("k") % 10).alias("unit"), F.col("k").alias("exercise"),
        F.col("event_type").isin("purchase", "signup", "view").alias("correct"), (F.col("event_type") == "view").alias("hint_used"),
        F.col("ts").alias("answered_at"), F.expr("unix_millis(cast(ts AS timestamp))").alias("ms"), F.col("value").alias("duration"), "event_type",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs: id, user_id, skill, source, duration_ms, created_at, steps, retries, approvals, status, error_code."""
    kind, k = F.col("event_type"), F.col("k")
    status = F.when(kind.isin("purchase", "signup"), "completed").when(kind == "error", "failed").when(kind == "click", "cancelled").otherwise("running")
    return _keyed(spark, sf_dir).select(
        F.col("event_id").alias("id"), "user_id", F.concat(F.lit("skill_"), (k % 4).cast("string")).alias("skill"),
        F.concat(F.lit("src_"), (F.col("user_id") % 2).cast("string")).alias("source"), F.col("value").alias("duration_ms"), F.col("ts").alias("created_at"),
        (k % 5).alias("steps"), (k % 3).alias("retries"), (k % 2).alias("approvals"), status.alias("status"),
        F.when(kind == "error", F.concat(F.lit("E"), (k % 7).cast("string"))).alias("error_code"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts: query_id and the first 80 characters of every benchmark item.

    These stand for what a user types; the texts that are searched are whole. A document is
    relevant to a query in the evaluations when it holds these characters.
    """
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 80).alias("query"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- cards about the documents, with sentences planted in them


def sentence(cases: list[str | None]) -> str:
    """SQL of the sentence for a row, by its doc_id; {a} and {b} are two words of its text. Spark and the oracle read it alike."""
    def one(case: str | None) -> str:
        if case is None:
            return "NULL"
        parts = [p for p in case.replace("{a}", "\x00a\x00").replace("{b}", "\x00b\x00").split("\x00") if p]
        return "concat('', " + ", ".join(p if p in ("a", "b") else f"'{p}'" for p in parts) + ")"

    return f"CASE doc_id % {len(cases)} " + " ".join(f"WHEN {i} THEN {one(c)}" for i, c in enumerate(cases)) + " END"


_WORDS = "'([A-Za-z]{4,})[^A-Za-z]+([A-Za-z]{4,})'"
_OWN_WORDS = ["doc_id", "coalesce(text, '') AS text", *[f"CASE WHEN coalesce(regexp_extract(text, {_WORDS}, {i}), '') = '' THEN '{w}' ELSE regexp_extract(text, {_WORDS}, {i}) END AS {c}" for i, c, w in ((1, "a", "alpha"), (2, "b", "beta"))]]


def card_fields(spark: SparkSession, sf_dir: str, fields: dict[str, tuple]) -> DataFrame:
    """(candidate, field, value, option): fields maps a name to (sentences, options or None, whether the document's text comes before)."""
    own = documents(spark, sf_dir).selectExpr(*_OWN_WORDS)
    parts = [own.selectExpr(*_field(name, *spec)) for name, spec in fields.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _field(name: str, said: list, options: list | None, whole: bool) -> list[str]:
    value = f"concat(text, chr(10), {sentence(said)})" if whole else sentence(said)
    return ["doc_id AS candidate", f"'{name}' AS field", f"CASE WHEN {sentence(said)} IS NOT NULL THEN {value} END AS value", f"{sentence(options) if options else 'CAST(NULL AS STRING)'} AS option"]


def card_evidence(spark: SparkSession, sf_dir: str, said: list, observations: list | None = None, legend: list | None = None) -> DataFrame:
    """(candidate, source, kind, text, observations, legend): the whole text of each document and a sentence; an image where observations are given."""
    own = documents(spark, sf_dir).selectExpr(*_OWN_WORDS)
    lists = lambda cases: f"CASE WHEN {sentence(cases)} IS NOT NULL THEN array({sentence(cases)}) END" if cases else "CAST(NULL AS ARRAY<STRING>)"
    out = own.selectExpr("doc_id AS candidate", "0 AS source", "'text' AS kind", f"concat(text, chr(10), coalesce({sentence(said)}, '')) AS text", "CAST(NULL AS ARRAY<STRING>) AS observations", "CAST(NULL AS ARRAY<STRING>) AS legend")
    if observations:
        out = out.unionByName(own.selectExpr("doc_id AS candidate", "1 AS source", "'image' AS kind", "CAST(NULL AS STRING) AS text", f"{lists(observations)} AS observations", f"{lists(legend)} AS legend"))
    return out


def cards_sql(fields: dict[str, tuple], said: list, observations: list | None = None, legend: list | None = None) -> str:
    """WITH own, fields, evidence: the same two tables for the oracle."""
    rows = " UNION ALL ".join(f"SELECT {', '.join(_field(n, *s))} FROM own" for n, s in fields.items())
    lists = lambda cases: f"CASE WHEN {sentence(cases)} IS NOT NULL THEN [{sentence(cases)}] END" if cases else "CAST(NULL AS VARCHAR[])"
    sources = f"SELECT doc_id AS candidate, 0 AS source, 'text' AS kind, concat(text, chr(10), coalesce({sentence(said)}, '')) AS text, CAST(NULL AS VARCHAR[]) AS observations, CAST(NULL AS VARCHAR[]) AS legend FROM own"
    if observations:
        sources += f" UNION ALL SELECT doc_id, 1, 'image', NULL, {lists(observations)}, {lists(legend)} FROM own"
    return f"WITH own AS (SELECT {', '.join(_OWN_WORDS)} FROM documents), fields AS ({rows}), evidence AS ({sources})"
