"""Review queries: bindings over the events table and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import review as R
from lorecraft.plans.registry import Registry

NOW_MS = 1706659200000
DAY = "2024-01-30"
query = Registry()

_STREAK = B.RV_SQL + """, s1 AS (
  SELECT *, (NOT correct OR coalesce(hint_used, FALSE)) AS bad FROM rv
), s2 AS (
  SELECT *, sum(bad::INT) OVER (PARTITION BY learner, unit ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS part FROM s1
), s3 AS (
  SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY learner, unit, part ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS streak FROM s2
), st AS (
  SELECT *, coalesce(lag(streak) OVER (PARTITION BY learner, unit ORDER BY ms, id), 0) AS prior_streak FROM s3
), sched AS (
  SELECT *, CASE WHEN bad THEN 1 ELSE [1, 3, 7, 14, 30][least(prior_streak, 4)::INT + 1] END AS interval_days FROM st
), due AS (
  SELECT *, ms + interval_days::BIGINT * 86400000 AS due_ms FROM sched
), snap AS (
  SELECT learner, unit, count(*) AS review_count, count(*) FILTER (WHERE correct) AS correct_count, count(*) FILTER (WHERE NOT correct) AS incorrect_count,
    count(*) FILTER (WHERE correct AND NOT hint_used) AS no_hint_correct_count, count(*) FILTER (WHERE hint_used) AS hint_used_count, count(DISTINCT exercise) AS exercise_count,
    arg_max(streak, (ms, id))::BIGINT AS consecutive_no_hint_correct, arg_max(correct, (ms, id)) AS last_correct, max(ms) AS last_reviewed_ms, arg_max(due_ms, (ms, id)) AS due_ms, arg_max(interval_days, (ms, id)) AS interval_days
  FROM due GROUP BY learner, unit
), lev AS (
  SELECT *, round(correct_count / review_count, 6) AS accuracy,
    CASE WHEN correct_count >= 3 AND no_hint_correct_count >= 3 AND exercise_count >= 2 AND consecutive_no_hint_correct >= 2 THEN 'multiple_verified'
      WHEN correct_count >= 2 AND no_hint_correct_count >= 2 AND last_correct THEN 'familiar' ELSE 'learning' END AS mastery_level
  FROM snap
), mast AS (
  SELECT *, CASE WHEN review_count < 2 THEN 'limited_evidence' WHEN mastery_level = 'multiple_verified' THEN 'multiple_verified'
    WHEN correct_count / review_count >= 0.8 THEN 'recently_successful' WHEN correct_count / review_count >= 0.45 THEN 'mixed_evidence' ELSE 'needs_support' END AS evidence_state
  FROM lev
)
"""
_RANK = "CASE mastery_level WHEN 'learning' THEN 1 WHEN 'familiar' THEN 3 WHEN 'multiple_verified' THEN 5 ELSE 0 END"
_QUEUE = _STREAK + f""", lastu AS (
  SELECT learner, arg_max(unit, (ms, id)) AS last_unit FROM rv GROUP BY learner
), act AS (
  SELECT DISTINCT learner, unit FROM rv WHERE event_type = 'click' AND ms >= {NOW_MS} - 5 * 86400000
), held AS (
  SELECT DISTINCT learner, unit FROM rv WHERE event_type = 'error' AND ms + 86400000 > {NOW_MS}
), q AS (
  SELECT m.learner, m.unit, m.due_ms, m.mastery_level, (a.unit IS NOT NULL) AS is_active,
    row_number() OVER (PARTITION BY m.learner ORDER BY (a.unit IS NOT NULL) DESC, (m.unit = l.last_unit) ASC, {_RANK}, m.due_ms, m.unit) AS position
  FROM mast m JOIN lastu l ON m.learner = l.learner LEFT JOIN act a ON a.learner = m.learner AND a.unit = m.unit
  WHERE m.due_ms <= {NOW_MS} AND NOT EXISTS (SELECT 1 FROM held h WHERE h.learner = m.learner AND h.unit = m.unit)
)
"""


@query("RV1_mastery_snapshot", _STREAK + "SELECT learner, unit, review_count, correct_count, incorrect_count, no_hint_correct_count, hint_used_count, exercise_count, accuracy, last_reviewed_ms FROM mast")
def rv1(spark, d):
    return R.mastery(B.review_events(spark, d)).select("learner", "unit", "review_count", "correct_count", "incorrect_count", "no_hint_correct_count", "hint_used_count", "exercise_count", "accuracy", "last_reviewed_ms")


@query("RV2_streak", _STREAK + "SELECT learner, unit, consecutive_no_hint_correct FROM mast")
def rv2(spark, d):
    return R.mastery(B.review_events(spark, d)).select("learner", "unit", "consecutive_no_hint_correct")


@query("RV3_mastery_level", _STREAK + "SELECT learner, unit, mastery_level FROM mast")
def rv3(spark, d):
    return R.mastery(B.review_events(spark, d)).select("learner", "unit", "mastery_level")


@query("RV4_evidence_state", _STREAK + "SELECT evidence_state, count(*) AS units FROM mast GROUP BY evidence_state")
def rv4(spark, d):
    return R.mastery(B.review_events(spark, d)).groupBy("evidence_state").agg(F.count("*").alias("units"))


@query("RV5_schedule", _STREAK + "SELECT id, prior_streak::BIGINT AS prior_streak, interval_days, due_ms FROM due")
def rv5(spark, d):
    return R.schedule(B.review_events(spark, d)).select("id", "prior_streak", "interval_days", "due_ms")


def corrections(spark, d):
    """Every error of a user whose id is even was corrected an hour later, and again a day later where the exercise is odd."""
    own = B.review_events(spark, d).filter("event_type = 'error' AND learner % 2 = 0")
    first = own.select(F.col("id").alias("event_id"), (F.col("id") * 2).alias("id"), (F.col("ms") + 3600000).alias("corrected_ms"), F.lit("step_order").alias("error_type"))
    again = own.filter("exercise % 2 = 1").select(F.col("id").alias("event_id"), (F.col("id") * 2 + 1).alias("id"), (F.col("ms") + 86400000).alias("corrected_ms"), F.lit("concept_confusion").alias("error_type"))
    return first.unionByName(again)


_CORR = B.RV_SQL + """, corr AS (
  SELECT id AS event_id, id * 2 AS id, ms + 3600000 AS corrected_ms, 'step_order' AS error_type FROM rv WHERE event_type = 'error' AND learner % 2 = 0
  UNION ALL SELECT id, id * 2 + 1, ms + 86400000, 'concept_confusion' FROM rv WHERE event_type = 'error' AND learner % 2 = 0 AND exercise % 2 = 1
), latest AS (
  SELECT event_id, arg_max(error_type, (corrected_ms, id)) AS corrected_type FROM corr GROUP BY event_id
)
"""


@query("RV6_latest_correction", _CORR + "SELECT * FROM latest")
def rv6(spark, d):
    return R.latest_corrections(corrections(spark, d))


@query("RV7_error_cause", _CORR + """SELECT learner, unit, coalesce(arg_max(coalesce(corrected_type, CASE WHEN exercise % 3 = 0 THEN 'missing_prerequisite' END, 'unknown'), (ms, rv.id)) FILTER (WHERE NOT correct), 'none') AS error_cause
FROM rv LEFT JOIN latest ON rv.id = latest.event_id GROUP BY learner, unit""")
def rv7(spark, d):
    answers = B.review_events(spark, d).withColumn("error_type", F.when(F.col("exercise") % 3 == 0, "missing_prerequisite"))
    return R.error_causes(answers, corrections(spark, d))


@query("RV9_legacy_mastery", _STREAK + f"SELECT learner, unit, {_RANK} AS mastery FROM mast")
def rv9(spark, d):
    return R.mastery(B.review_events(spark, d)).select("learner", "unit", R.legacy_mastery(F.col("mastery_level")).alias("mastery"))


def queue(spark, d):
    rv = B.review_events(spark, d)
    last = rv.groupBy("learner").agg(F.max_by("unit", F.struct("ms", "id")).alias("last_unit"))
    units = R.mastery(rv).select("learner", "unit", "mastery_level").join(R.latest_state(rv), ["learner", "unit"]).join(last, "learner")
    active = rv.filter((F.col("event_type") == "click") & (F.col("ms") >= NOW_MS - 5 * R.DAY_MS))
    held = rv.filter("event_type = 'error'").select("learner", "unit", (F.col("ms") + R.DAY_MS).alias("until_ms"))
    return R.due_queue(units, active, held, NOW_MS)


@query("RV10_due_queue", _QUEUE + "SELECT * FROM q")
def rv10(spark, d):
    return queue(spark, d).select("learner", "unit", "due_ms", "mastery_level", "is_active", "position")


@query("RV13_review_overview", _QUEUE + f"""SELECT l.learner, coalesce(h.due, 0) AS due, h.head_unit, coalesce(t.answered, 0) AS answered, (l.learner % 25)::INT AS raw_goal, greatest(1, least(20, (l.learner % 25)::INT)) AS daily_goal,
  greatest(greatest(1, least(20, l.learner % 25)) - coalesce(t.answered, 0), 0) AS remaining,
  CASE WHEN coalesce(t.answered, 0) >= greatest(1, least(20, l.learner % 25)) THEN 'goal_reached' WHEN coalesce(h.due, 0) = 0 THEN 'nothing_due' ELSE 'ready' END AS status
FROM (SELECT DISTINCT learner FROM rv) l LEFT JOIN (SELECT learner, count(*) AS due, arg_min(unit, position) AS head_unit FROM q GROUP BY learner) h ON l.learner = h.learner
LEFT JOIN (SELECT learner, count(*) AS answered FROM rv WHERE strftime(answered_at, '%Y-%m-%d') = '{DAY}' GROUP BY learner) t ON l.learner = t.learner""".replace("(l.learner % 25)::INT AS raw_goal, ", ""))
def rv13(spark, d):
    rv = B.review_events(spark, d)
    learners = rv.select("learner").distinct().withColumn("goal", F.col("learner") % 25)
    return R.overview(queue(spark, d), R.day_state(rv), learners, DAY)


@query("RV14_day_state", B.RV_SQL + "SELECT learner, strftime(answered_at, '%Y-%m-%d') AS day, count(*) AS answered, arg_max(unit, (ms, id)) AS last_unit FROM rv GROUP BY ALL")
def rv14(spark, d):
    return R.day_state(B.review_events(spark, d))


@query("RV16_exercise_rotation", B.RV_SQL + """, ex AS (SELECT DISTINCT unit, exercise, exercise % 4 = 0 AS derived FROM rv), used AS (SELECT learner, exercise, max(ms) AS last_used_ms FROM rv GROUP BY ALL)
SELECT l.learner, l.unit, ex.exercise, derived, last_used_ms, row_number() OVER (PARTITION BY l.learner, l.unit ORDER BY last_used_ms IS NOT NULL, derived, last_used_ms, ex.exercise) AS turn
FROM (SELECT DISTINCT learner, unit FROM rv) l JOIN ex ON l.unit = ex.unit LEFT JOIN used ON used.learner = l.learner AND used.exercise = ex.exercise""")
def rv16(spark, d):
    rv = B.review_events(spark, d)
    exercises = rv.select("unit", "exercise", (F.col("exercise") % 4 == 0).alias("derived")).distinct()
    return R.rotation(exercises, rv).select("learner", "unit", "exercise", "derived", "last_used_ms", "turn")


@query("RV20_exercise_as_of", B.RV_SQL + """, v AS (SELECT DISTINCT exercise, n AS version, 1704067200000 + n * (exercise % 7 + 1) * 86400000::BIGINT AS from_ms FROM rv, range(0, 5) r(n))
SELECT rv.id, arg_max(version, (from_ms, version)) AS version FROM rv JOIN v ON rv.exercise = v.exercise AND from_ms <= ms GROUP BY rv.id""")
def rv20(spark, d):
    rv = B.review_events(spark, d)
    versions = rv.select("exercise").distinct().withColumn("version", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    versions = versions.withColumn("from_ms", F.lit(1704067200000) + F.col("version") * (F.col("exercise") % 7 + 1) * F.lit(R.DAY_MS))
    return R.exercise_as_of(rv.select("id", "exercise", "ms"), versions)


@query("RV22_answer_enrichment", _STREAK + """SELECT id, interval_days, strftime(answered_at, '%Y-%m-%d') AS day, count(*) OVER (PARTITION BY learner, strftime(answered_at, '%Y-%m-%d') ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS daily_answered_after,
  CASE WHEN sum(correct::INT) OVER w >= 3 AND sum((correct AND NOT hint_used)::INT) OVER w >= 3 AND len(list_distinct(list(exercise) OVER w)) >= 2 AND streak >= 2 THEN 'multiple_verified'
    WHEN sum(correct::INT) OVER w >= 2 AND sum((correct AND NOT hint_used)::INT) OVER w >= 2 AND correct THEN 'familiar' ELSE 'learning' END AS mastery_after
FROM due WINDOW w AS (PARTITION BY learner, unit ORDER BY ms, id ROWS UNBOUNDED PRECEDING)""")
def rv22(spark, d):
    return R.enriched(B.review_events(spark, d)).select("id", "interval_days", "day", "daily_answered_after", "mastery_after")


_MUT = B.RV_SQL + ", m AS (SELECT id, exercise AS fingerprint, 0 AS seq FROM rv UNION ALL SELECT id, exercise + (id % 2)::INT, 1 FROM rv WHERE id % 7 = 0)\n"


@query("RV23_idempotent_mutations", _MUT + "SELECT id, count(*) AS copies, count(DISTINCT fingerprint) > 1 AS conflict, arg_min(fingerprint, seq) AS kept FROM m GROUP BY id")
def rv23(spark, d):
    rv = B.review_events(spark, d)
    first = rv.select("id", F.col("exercise").alias("fingerprint"), F.lit(0).alias("seq"))
    again = rv.filter("id % 7 = 0").select("id", (F.col("exercise") + F.col("id") % 2).cast("int").alias("fingerprint"), F.lit(1).alias("seq"))
    return R.idempotent(first.unionByName(again))


@query("RV24_deferral", B.RV_SQL + """SELECT id, epoch_us(CASE exercise % 3 WHEN 0 THEN answered_at + INTERVAL 1 HOUR WHEN 1 THEN date_trunc('day', answered_at) + INTERVAL 32 HOUR ELSE date_trunc('day', answered_at) + INTERVAL 24 HOUR END) // 1000 AS until_ms FROM rv""")
def rv24(spark, d):
    kind = F.get(F.array(F.lit("later"), F.lit("tomorrow"), F.lit("skip_today")), F.col("exercise") % 3)
    until = R.deferred_until(kind, F.col("answered_at").cast("timestamp"))
    return B.review_events(spark, d).select("id", F.unix_millis(until).alias("until_ms"))


@query("RV25_staggered_release", B.RV_SQL + f", c AS (SELECT learner, unit, learner * 100 + unit AS card FROM rv GROUP BY ALL) SELECT learner, unit, card, {NOW_MS} + (1 + (row_number() OVER (PARTITION BY learner ORDER BY card) - 1) // 3) * 86400000 AS release_ms FROM c")
def rv25(spark, d):
    cards = B.review_events(spark, d).select("learner", "unit").distinct().withColumn("card", F.col("learner") * 100 + F.col("unit"))
    return R.staggered(cards, "learner", "card", 3, NOW_MS)


@query("RV28_unit_or_card_match", B.RV_SQL + """, c AS (SELECT DISTINCT exercise AS card_id, (exercise * 7) % 10 AS unit_ref FROM rv)
SELECT card_id, count(DISTINCT rv.id) AS events FROM c JOIN rv ON rv.unit = c.unit_ref OR rv.exercise = c.card_id GROUP BY card_id""")
def rv28(spark, d):
    rv = B.review_events(spark, d)
    cards = rv.select(F.col("exercise").alias("card_id"), ((F.col("exercise") * 7) % 10).alias("unit_ref")).distinct()
    return R.matching(rv, cards)


@query("RV29_retention", B.RV_SQL + f"""SELECT learner, id, ms, place FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY ms DESC, id DESC) AS place FROM (SELECT * FROM rv WHERE ms >= {NOW_MS} - 10 * 86400000::BIGINT OR event_type = 'click')) WHERE place <= 20""")
def rv29(spark, d):
    attempts = B.review_events(spark, d).select("learner", "id", "ms", (F.col("event_type") == "click").alias("active"))
    return R.retained(attempts, NOW_MS, 10, 20).select("learner", "id", "ms", "place")
