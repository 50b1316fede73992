"""Queries of the review flow, preferences, recommendation pools and plans, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import library as L
from lorecraft.operators import review as R
from lorecraft.operators import scalars as V
from lorecraft.plans.registry import Registry
from lorecraft.plans.review import _STREAK, DAY, NOW_MS
from lorecraft.plans.scalars import pick

query = Registry()
_RV = B.RV_SQL


def due_mastery(answers):
    """mastery with the due time that the latest answer set."""
    due = R.schedule(answers).groupBy(*R.KEY).agg(F.max_by("due_ms", F.struct("ms", "id")).alias("due_ms"))
    return R.mastery(answers).join(due, R.KEY)


@query("RV8_choice_cause", _RV + "SELECT id, CASE WHEN correct THEN 'none' ELSE ['missing_prerequisite', 'unknown', 'step_order', 'supported_misconception'][exercise % 4 + 1] END AS cause FROM rv")
def rv8(spark, d):
    text = pick(F.col("exercise"), "忽略了前提", "", "步骤颠倒", "凭感觉")
    return B.review_events(spark, d).select("id", L.choice_cause(F.col("correct"), text, V.misconception).alias("cause"))


@query("RV11_active_state", _RV + f""", a AS (SELECT learner, unit, arg_max(id, (ms, id)) AS attempt FROM rv WHERE event_type = 'click' GROUP BY ALL), u AS (SELECT learner, unit, arg_max(ms + 2 * 86400000, (ms, id)) AS until FROM rv WHERE event_type = 'error' AND ms + 2 * 86400000 > {NOW_MS} GROUP BY ALL)
SELECT coalesce(a.learner, u.learner) AS learner, coalesce(a.unit, u.unit) AS unit, attempt, until FROM a FULL JOIN u ON a.learner = u.learner AND a.unit = u.unit""")
def rv11(spark, d):
    rv = B.review_events(spark, d)
    attempts = rv.withColumn("status", F.when(F.col("event_type") == "click", "active").otherwise("answered"))
    deferrals = rv.filter("event_type = 'error'").withColumn("until", F.col("ms") + 2 * L.DAY_MS)
    return L.active_state(attempts, deferrals, ["learner", "unit"], NOW_MS)


_CARDS = _RV + f""", cards AS (SELECT learner, id, ms + (exercise % 40)::BIGINT * 86400000 AS due_ms, CASE WHEN exercise % 3 = 0 THEN 'new' ELSE 'learning' END AS stage, CASE WHEN exercise % 5 = 0 THEN ms END AS completed_at FROM rv),
staged AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY due_ms, id) AS position FROM cards WHERE stage = 'new' AND completed_at IS NULL AND due_ms > {NOW_MS})
"""


def cards(spark, d):
    k = F.col("exercise")
    return B.review_events(spark, d).select("learner", "id", (F.col("ms") + (k % 40).cast("long") * F.lit(L.DAY_MS)).alias("due_ms"), F.when(k % 3 == 0, "new").otherwise("learning").alias("stage"), F.when(k % 5 == 0, F.col("ms")).alias("completed_at"))


@query("RV12_staged_cards", _CARDS + "SELECT learner, id, position FROM staged")
def rv12(spark, d):
    return L.staged(cards(spark, d), NOW_MS).select("learner", "id", "position")


@query("RV30_released_card", _CARDS + f"SELECT learner, id, {NOW_MS}::BIGINT AS due_ms FROM staged WHERE position = 1 AND learner NOT IN (SELECT learner FROM cards WHERE due_ms <= {NOW_MS} AND completed_at IS NULL)")
def rv30(spark, d):
    return L.released(cards(spark, d), NOW_MS)


@query("RV15_daily_goal", _RV + f"""SELECT learner, count(*) AS answered, CASE WHEN learner % 7 = 0 THEN 3 ELSE greatest(1, least(20, learner % 30)) END::INT AS goal, count(*) >= CASE WHEN learner % 7 = 0 THEN 3 ELSE greatest(1, least(20, learner % 30)) END AS complete FROM rv WHERE strftime(answered_at, '%Y-%m-%d') = '{DAY}' GROUP BY learner""")
def rv15(spark, d):
    own = B.review_events(spark, d).filter(F.date_format("answered_at", "yyyy-MM-dd") == DAY).groupBy("learner").agg(F.count("*").alias("answered"))
    goal = R.daily_goal(F.when(F.col("learner") % 7 != 0, F.col("learner") % 30))
    return own.select("learner", "answered", goal.cast("int").alias("goal"), (F.col("answered") >= goal).alias("complete"))


@query("RV17_reasons", _STREAK + "SELECT learner, unit, CASE WHEN incorrect_count > 0 AND unit % 3 <> 0 THEN 'recent_error,due_card' ELSE 'due_card' END AS reasons FROM mast")
def rv17(spark, d):
    snap = R.mastery(B.review_events(spark, d)).withColumn("error_type", F.when(F.col("unit") % 3 == 0, "none").otherwise("unknown"))
    return L.reasons(snap).select("learner", "unit", F.array_join("reasons", ",").alias("reasons"))


@query("RV18_difficulty", _STREAK + "SELECT learner, unit, CASE learner % 4 WHEN 0 THEN 'foundation' WHEN 1 THEN 'challenge' ELSE CASE mastery_level WHEN 'multiple_verified' THEN 'challenge' WHEN 'familiar' THEN 'standard' ELSE 'foundation' END END AS difficulty FROM mast")
def rv18(spark, d):
    preference = pick(F.col("learner"), "foundational", "advanced", "balanced", None)
    return R.mastery(B.review_events(spark, d)).select("learner", "unit", L.review_difficulty(F.col("mastery_level"), preference).alias("difficulty"))


@query("RV21_graded", _RV + """, a AS (SELECT id, CASE WHEN exercise % 3 = 0 THEN 'recall' ELSE 'choice' END AS kind, exercise % 4 AS correct_index, CASE WHEN exercise % 7 <> 0 THEN unit - 1 END AS chosen, CASE WHEN exercise % 6 <> 0 THEN correct END AS self_assessed, event_type <> 'signup' AS revealed, CASE WHEN exercise % 11 = 0 THEN 'answered' ELSE 'active' END AS status FROM rv),
f AS (SELECT *, CASE WHEN status <> 'active' THEN 'already_answered' WHEN kind = 'recall' AND NOT revealed THEN 'not_revealed' WHEN kind = 'recall' AND self_assessed IS NULL THEN 'not_assessed' WHEN kind = 'choice' AND (chosen IS NULL OR chosen NOT BETWEEN 0 AND 3) THEN 'not_answered' END AS fault FROM a)
SELECT id, fault, CASE WHEN fault IS NULL THEN CASE WHEN kind = 'recall' THEN self_assessed ELSE chosen = correct_index END END AS correct FROM f""")
def rv21(spark, d):
    k = F.col("exercise")
    attempts = B.review_events(spark, d).select(
        "id", F.when(k % 3 == 0, "recall").otherwise("choice").alias("kind"), F.array(*[F.lit(x) for x in "abcd"]).alias("options"), (k % 4).alias("correct_index"), F.when(k % 7 != 0, F.col("unit") - 1).alias("chosen"),
        F.when(k % 6 != 0, F.col("correct")).alias("self_assessed"), (F.col("event_type") != "signup").alias("revealed"), F.when(k % 11 == 0, "answered").otherwise("active").alias("status"),
    )
    return L.graded(attempts).select("id", "fault", "correct")


@query("RV26_correction_log", _RV + """, c AS (SELECT id, exercise AS event_id, ms, 't' || id % 3 AS to_type FROM rv WHERE event_type = 'error') SELECT id, event_id, coalesce(lag(to_type) OVER (PARTITION BY event_id ORDER BY ms, id), 'e' || event_id % 4) AS from_type, to_type FROM c""")
def rv26(spark, d):
    rv = B.review_events(spark, d)
    c = rv.filter("event_type = 'error'").select("id", F.col("exercise").alias("event_id"), "ms", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("to_type"))
    e = rv.select(F.col("exercise").alias("event_id")).distinct().withColumn("error_type", F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string")))
    return L.corrections_log(c, e)


@query("RV27_evidence", _STREAK + """, e AS (SELECT learner, unit, id, row_number() OVER (PARTITION BY learner, unit ORDER BY ms DESC, id DESC) AS position FROM rv), c AS (SELECT id AS event_id, count(*) AS corrections FROM rv WHERE event_type = 'error' GROUP BY id)
SELECT e.learner, e.unit, e.id, e.position, coalesce(corrections, 0) AS corrections, mastery_level FROM e LEFT JOIN c ON c.event_id = e.id JOIN mast m ON m.learner = e.learner AND m.unit = e.unit""")
def rv27(spark, d):
    rv = B.review_events(spark, d)
    corrections = rv.filter("event_type = 'error'").groupBy("id").agg(F.count("*").alias("corrections"))
    ranked = L.first_rows(rv.select("learner", "unit", "id", "ms"), ["learner", "unit"], [F.col("ms").desc(), F.col("id").desc()], 2**31 - 1, "position")
    told = ranked.join(corrections, "id", "left").join(R.mastery(rv).select("learner", "unit", "mastery_level"), ["learner", "unit"])
    return told.select("learner", "unit", "id", "position", F.coalesce("corrections", F.lit(0)).alias("corrections"), "mastery_level")


@query("RT19_due_list", _STREAK + f""", l AS (SELECT learner, unit, strftime(max(answered_at) FILTER (WHERE correct), '%Y-%m-%d') AS day FROM rv GROUP BY ALL), c AS (SELECT m.learner, m.unit, CASE WHEN m.unit % 4 = 0 THEN NULL ELSE due_ms END AS due_ms, day FROM mast m JOIN l ON l.learner = m.learner AND l.unit = m.unit)
SELECT learner, unit, row_number() OVER (PARTITION BY learner ORDER BY coalesce(due_ms, 0), unit) AS position FROM c WHERE (due_ms IS NULL OR due_ms <= {NOW_MS}) AND coalesce(day <> '{DAY}', TRUE)""")
def rt19(spark, d):
    rv = B.review_events(spark, d)
    day = rv.filter("correct").groupBy("learner", "unit").agg(F.date_format(F.max("answered_at"), "yyyy-MM-dd").alias("last_correct_day"))
    c = due_mastery(rv).select("learner", "unit", F.when(F.col("unit") % 4 != 0, F.col("due_ms")).alias("due_ms")).join(day, ["learner", "unit"], "left")
    return L.due_list(c, NOW_MS, DAY).select("learner", "unit", "position")


# ---- preferences


_ACTIONS = ["like_topic", "less_topic", "exclude_unit", "already_familiar", "too_simple", "too_hard", "unknown"]
_SQL_ACTIONS = "['" + "', '".join(_ACTIONS) + "']"


@query("ME9_feedback_preferences", _RV + f""", f AS (SELECT id, {_SQL_ACTIONS}[exercise % 7 + 1] AS a, CASE WHEN exercise % 4 = 0 THEN '' ELSE 't' || unit END AS topic, 'u' || unit AS unit FROM rv)
SELECT id, CASE a WHEN 'like_topic' THEN 'topic_interest' WHEN 'less_topic' THEN 'topic_downrank' WHEN 'exclude_unit' THEN 'unit_exclusion' WHEN 'already_familiar' THEN 'self_familiarity' ELSE 'difficulty_preference' END AS category,
CASE a WHEN 'too_simple' THEN 'advanced' WHEN 'too_hard' THEN 'foundational' WHEN 'like_topic' THEN nullif(topic, '') WHEN 'less_topic' THEN nullif(topic, '') ELSE coalesce(nullif(topic, ''), unit) END AS value FROM f WHERE a <> 'unknown'""")
def me9(spark, d):
    unit = F.col("unit").cast("string")
    f = B.review_events(spark, d).select("id", pick(F.col("exercise"), *_ACTIONS).alias("action"), F.when(F.col("exercise") % 4 == 0, "").otherwise(F.concat(F.lit("t"), unit)).alias("topic"), F.concat(F.lit("u"), unit).alias("unit"))
    return L.feedback_preferences(f)


_PREFS = _RV + """, p AS (SELECT id, learner, ['topic_interest', 'topic_downrank', 'unit_exclusion', 'self_familiarity', 'learning_format'][exercise % 5 + 1] AS category, ['unit', 'topic', 'global'][exercise % 3 + 1] AS scope_type, unit AS scope_id, exercise % 4 <> 0 AS enabled, ms AS updated_ms FROM rv WHERE event_type = 'signup')
"""


def preferences(spark, d):
    k = F.col("exercise")
    return B.review_events(spark, d).filter("event_type = 'signup'").select(
        "id", "learner", pick(k, "topic_interest", "topic_downrank", "unit_exclusion", "self_familiarity", "learning_format").alias("category"), pick(k, "unit", "topic", "global").alias("scope_type"),
        F.col("unit").alias("scope_id"), (k % 4 != 0).alias("enabled"), F.col("ms").alias("updated_ms"),
    )


@query("ME11_preference_counts", _PREFS + "SELECT category, count(*) FILTER (WHERE enabled) AS active, count(*) AS total FROM p GROUP BY category")
def me11(spark, d):
    return preferences(spark, d).groupBy("category").agg(F.count_if("enabled").alias("active"), F.count("*").alias("total"))


@query("ME12_candidate_memory", _RV + "SELECT id, CASE WHEN unit % 2 = 0 AND exercise % 3 = 0 AND exercise % 5 <> 4 THEN CASE WHEN exercise % 5 < 2 THEN 'confirmed' ELSE 'ignored' END ELSE CASE WHEN exercise % 3 = 0 THEN 'pending' ELSE 'done' END END AS status FROM rv")
def me12(spark, d):
    rv, k = B.review_events(spark, d), F.col("exercise")
    c = rv.select("id", (F.col("unit") % 2 == 0).alias("eligible"), F.when(k % 3 == 0, "pending").otherwise("done").alias("status"))
    return L.candidate_memory(c, rv.filter(k % 5 != 4).select("id", (k % 5 < 2).alias("confirm")))


@query("ME13_learning_view", _PREFS + "SELECT learner, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY CASE scope_type WHEN 'unit' THEN 3 WHEN 'topic' THEN 2 ELSE 1 END DESC, updated_ms DESC, id) AS rank FROM p WHERE enabled) WHERE rank <= 8")
def me13(spark, d):
    return L.by_scope(preferences(spark, d), "learner", 8).select("learner", "id", "rank")


@query("ME14_clear_recent", _RV + f"SELECT learner, count(*) AS cleared FROM rv WHERE ms >= {NOW_MS} - 30 * 86400000::BIGINT AND learner % 9 = 0 GROUP BY learner")
def me14(spark, d):
    """Recent facts that the learners who asked for it lose; preferences are another table and stay."""
    return B.review_events(spark, d).filter((F.col("ms") >= NOW_MS - 30 * L.DAY_MS) & (F.col("learner") % 9 == 0)).groupBy("learner").agg(F.count("*").alias("cleared"))


@query("ME15_concept_mastery", _STREAK + "SELECT learner, count(*) AS units, count(*) FILTER (WHERE mastery_level = 'multiple_verified') AS verified, count(*) FILTER (WHERE mastery_level = 'familiar') AS familiar, count(*) FILTER (WHERE evidence_state = 'needs_support') AS needs_support FROM mast GROUP BY learner")
def me15(spark, d):
    m, e = F.col("mastery_level"), F.col("evidence_state")
    return R.mastery(B.review_events(spark, d)).groupBy("learner").agg(F.count("*").alias("units"), F.count_if(m == "multiple_verified").alias("verified"), F.count_if(m == "familiar").alias("familiar"), F.count_if(e == "needs_support").alias("needs_support"))


@query("ME17_library_overview", _STREAK + f"SELECT learner, count(*) AS cards, count(*) FILTER (WHERE due_ms <= {NOW_MS}) AS due, array_to_string(list(unit ORDER BY last_reviewed_ms DESC, unit)[1:5], ',') AS newest FROM mast GROUP BY learner")
def me17(spark, d):
    m = due_mastery(B.review_events(spark, d))
    newest = L.first_rows(m, ["learner"], [F.col("last_reviewed_ms").desc(), "unit"], 5).groupBy("learner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit"))), lambda x: x["unit"].cast("string")), ",").alias("newest"))
    return m.groupBy("learner").agg(F.count("*").alias("cards"), F.count_if(F.col("due_ms") <= NOW_MS).alias("due")).join(newest, "learner")


# ---- recommendation


@query("DS8_weak_units", _STREAK + "SELECT learner, unit, rank FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY incorrect_count DESC, last_reviewed_ms DESC, unit) AS rank FROM mast WHERE mastery_level <> 'multiple_verified') WHERE rank <= 3")
def ds8(spark, d):
    return L.weak_units(R.mastery(B.review_events(spark, d))).select("learner", "unit", "rank")


@query("DS7_interest_order", _RV + """, x AS (SELECT learner, unit AS seed, min(exercise // 10) AS pool FROM rv WHERE event_type = 'view' GROUP BY ALL)
SELECT i.learner, i.seed, row_number() OVER (PARTITION BY i.learner ORDER BY pool DESC NULLS FIRST, i.seed) AS position FROM (SELECT DISTINCT learner, unit AS seed FROM rv WHERE event_type = 'purchase') i LEFT JOIN x ON x.learner = i.learner AND x.seed = i.seed""")
def ds7(spark, d):
    rv = B.review_events(spark, d)
    interests = rv.filter("event_type = 'purchase'").select("learner", F.col("unit").alias("seed")).distinct()
    exposures = rv.filter("event_type = 'view'").select("learner", F.col("unit").alias("seed"), F.floor(F.col("exercise") / 10).cast("int").alias("pool"))
    return L.interests_by_exposure(interests, exposures).select("learner", "seed", "position")


@query("DS9_capped_seeds", _RV + """, s AS (SELECT learner, exercise % 30 AS seed, row_number() OVER (PARTITION BY learner ORDER BY ms, id) AS place, event_type AS kind, exercise AS score FROM rv), o AS (SELECT learner, seed, min(place) AS first, arg_max(kind, place) AS kind, arg_max(score, place) AS score FROM s GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY first) AS n, count(*) OVER (PARTITION BY learner) AS al FROM o)
SELECT learner, seed, kind, score, row_number() OVER (PARTITION BY learner ORDER BY CASE WHEN n = al AND learner % 2 = 0 THEN 2.5 ELSE n END, n) AS position FROM n WHERE n < 10 OR n = al""")
def ds9(spark, d):
    from pyspark.sql import Window

    rv = B.review_events(spark, d)
    seeds = rv.select("learner", (F.col("exercise") % 30).alias("seed"), F.row_number().over(Window.partitionBy("learner").orderBy("ms", "id")).alias("place"), F.col("event_type").alias("kind"), F.col("exercise").alias("score"))
    return L.capped_seeds(seeds, rv.filter("learner % 2 = 0").select("learner").distinct())


@query("DS15_preference_flags", _PREFS + """, c AS (SELECT id, learner, unit, exercise % 6 AS topic FROM rv WHERE event_type = 'view'), j AS (SELECT c.learner, c.id, CASE WHEN scope_type = 'global' OR (scope_type = 'unit' AND scope_id = unit) OR (scope_type = 'topic' AND scope_id = topic) THEN category END AS k FROM c LEFT JOIN (SELECT learner, category, scope_type, scope_id FROM p WHERE enabled) p ON p.learner = c.learner)
SELECT learner, id, coalesce(bool_or(k = 'topic_downrank'), FALSE) AS downranked, coalesce(bool_or(k = 'unit_exclusion'), FALSE) AS excluded, coalesce(bool_or(k = 'self_familiarity'), FALSE) AS familiar, count(k) AS applied FROM j GROUP BY ALL""")
def ds15(spark, d):
    c = B.review_events(spark, d).filter("event_type = 'view'").select("id", "learner", "unit", (F.col("exercise") % 6).alias("topic"))
    return L.preference_flags(c, preferences(spark, d).filter("enabled").select("learner", "category", "scope_type", "scope_id"))


@query("DS21_seen_memory", _RV + "SELECT session, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ms DESC, key) AS rank FROM (SELECT unit AS session, exercise * 1000 + learner % 50 AS key, max(ms) AS ms FROM rv GROUP BY ALL)) WHERE rank <= 120")
def ds21(spark, d):
    e = B.review_events(spark, d).select(F.col("unit").alias("session"), (F.col("exercise") * 1000 + F.col("learner") % 50).alias("key"), "ms")
    return L.seen_memory(e).select("session", "key", "rank")


_POOLS = _RV + """, pools AS (SELECT id, learner, ms AS created_ms, CASE WHEN exercise % 6 = 0 THEN 'discovery-pool-v1' ELSE 'discovery-pool-v2.1' END AS version, ['active', 'empty', 'dismissed'][exercise % 3 + 1] AS status, exercise % 2 AS memory_version, unit % 2 AS current_memory FROM rv WHERE event_type <> 'error')
"""


def pools(spark, d):
    k = F.col("exercise")
    return B.review_events(spark, d).filter("event_type <> 'error'").select("id", "learner", F.col("ms").alias("created_ms"), F.when(k % 6 == 0, "discovery-pool-v1").otherwise(L.POOL_VERSION).alias("version"), pick(k, "active", "empty", "dismissed").alias("status"), (k % 2).alias("memory_version"), (F.col("unit") % 2).alias("current_memory"))


@query("DS22_reusable_pools", _POOLS + f"SELECT learner, id FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY created_ms DESC, id) AS r FROM pools WHERE version = 'discovery-pool-v2.1' AND status IN ('active', 'empty') AND memory_version = current_memory AND {NOW_MS} - created_ms < 86400000) WHERE r = 1")
def ds22(spark, d):
    return L.reusable_pools(pools(spark, d), NOW_MS).select("learner", "id")


@query("DS23_kept_pools", _POOLS + "SELECT learner, id, CASE WHEN id % 9 = 0 THEN 'refreshed' ELSE status END AS status, rank FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY created_ms DESC, id DESC) AS rank FROM pools) WHERE rank <= 20")
def ds23(spark, d):
    own = pools(spark, d)
    return L.kept_pools(own, own.filter("id % 9 = 0").select("id")).select("learner", "id", "status", "rank")


@query("M12_pool_versions", _POOLS + "SELECT id, CASE WHEN version <> 'discovery-pool-v2.1' AND status IN ('active', 'empty') THEN 'stale' ELSE status END AS status FROM pools")
def m12(spark, d):
    return L.gated_pools(pools(spark, d)).select("id", "status")


@query("DS27_visible_candidates", _RV + "SELECT unit AS pool, count(*) AS visible FROM rv WHERE exercise % 4 < 2 GROUP BY unit")
def ds27(spark, d):
    status = pick(F.col("exercise"), "available", "opened", "dismissed", "feedback_applied")
    return B.review_events(spark, d).withColumn("status", status).filter(~F.col("status").isin(L.HIDDEN)).groupBy(F.col("unit").alias("pool")).agg(F.count("*").alias("visible"))


# ---- plans


_PLAN = """WITH u AS (SELECT l_orderkey AS plan, l_linenumber AS unit, l_quantity > 10 AS selected, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'r' || l_partkey % 5 END AS skip_reason, CASE WHEN l_suppkey % 7 = 0 THEN 'merged' ELSE 'active' END AS disposition, l_partkey % 6 = 0 AS undecided, l_partkey % 4 <> 0 AS retained, 10 - l_linenumber AS ord FROM lineitem),
dr AS (SELECT l_orderkey AS plan, l_linenumber AS unit, CASE l_returnflag WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'generating' ELSE 'passed' END AS status, l_tax > 0.03 AS has_card FROM lineitem WHERE l_linestatus = 'F')
"""


def plan_units(spark, d):
    return B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("unit"), (F.col("l_quantity") > 10).alias("selected"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("r"), (F.col("l_partkey") % 5).cast("string"))).alias("skip_reason"),
        F.when(F.col("l_suppkey") % 7 == 0, "merged").otherwise("active").alias("disposition"), (F.col("l_partkey") % 6 == 0).alias("undecided"), (F.col("l_partkey") % 4 != 0).alias("retained"), (10 - F.col("l_linenumber")).alias("order"),
    )


def plan_drafts(spark, d):
    flag = F.col("l_returnflag")
    return B.table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("unit"), F.when(flag == "R", "confirmed").when(flag == "A", "generating").otherwise("passed").alias("status"), (F.col("l_tax") > 0.03).alias("has_card"))


_COVER = _PLAN + ", cov AS (SELECT u.plan, u.unit, CASE WHEN selected THEN coalesce(dr.status, 'pending') ELSE 'skipped' END AS status, CASE WHEN selected THEN '' ELSE coalesce(nullif(skip_reason, ''), 'not_selected') END AS reason FROM u LEFT JOIN dr ON dr.plan = u.plan AND dr.unit = u.unit WHERE disposition = 'active')\n"


@query("PL4_coverage", _COVER + "SELECT * FROM cov")
def pl4(spark, d):
    return L.plan_coverage(plan_units(spark, d), plan_drafts(spark, d).drop("has_card"))


@query("PL5_plan_list", _COVER + ", s AS (SELECT plan, count(*) FILTER (WHERE selected) AS selected FROM u GROUP BY plan) SELECT s.plan, coalesce(c.total, 0) AS total, selected, coalesce(c.confirmed, 0) AS confirmed FROM s LEFT JOIN (SELECT plan, count(*) AS total, count(*) FILTER (WHERE status = 'confirmed') AS confirmed FROM cov GROUP BY plan) c USING (plan)")
def pl5(spark, d):
    units = plan_units(spark, d)
    cov = L.plan_coverage(units, plan_drafts(spark, d).drop("has_card")).groupBy("plan").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return units.groupBy("plan").agg(F.count_if("selected").alias("selected")).join(cov, "plan", "left").select("plan", zero("total"), "selected", zero("confirmed"))


@query("PL8_retained_targets", _PLAN + "SELECT plan, unit FROM u WHERE selected AND disposition = 'active' AND retained AND NOT EXISTS (SELECT 1 FROM dr WHERE dr.plan = u.plan AND dr.unit = u.unit AND status = 'confirmed')")
def pl8(spark, d):
    return L.retained_targets(plan_units(spark, d), plan_drafts(spark, d))


@query("PL9_discarded_plans", _PLAN + """, c AS (SELECT plan, unit FROM u WHERE EXISTS (SELECT 1 FROM dr WHERE dr.plan = u.plan AND dr.unit = u.unit AND status = 'confirmed'))
SELECT p.plan, count(*) AS units, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM c b WHERE b.plan = p.plan AND b.unit = p.unit + 1)) AS relations FROM c p GROUP BY p.plan""")
def pl9(spark, d):
    units = plan_units(spark, d)
    relations = units.select("plan", F.col("unit").alias("from_unit"), (F.col("unit") + 1).alias("to_unit"))
    left, rel = L.discarded(units, relations, plan_drafts(spark, d))
    counts = rel.groupBy("plan").agg(F.count("*").alias("relations"))
    return left.groupBy("plan").agg(F.count("*").alias("units")).join(counts, "plan", "left").select("plan", "units", F.coalesce("relations", F.lit(0)).alias("relations"))


@query("PL11_worklist", _PLAN + "SELECT plan, unit, position FROM (SELECT plan, unit, row_number() OVER (PARTITION BY plan ORDER BY ord, unit) AS position FROM u WHERE selected AND disposition = 'active' AND NOT undecided AND NOT EXISTS (SELECT 1 FROM dr WHERE dr.plan = u.plan AND dr.unit = u.unit AND (status = 'confirmed' OR (has_card AND status <> 'generating')))) WHERE position <= 3")
def pl11(spark, d):
    return L.worklist(plan_units(spark, d), plan_drafts(spark, d))


@query("PL10_source_freshness", """WITH m AS (SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN -1 ELSE doc_id END AS doc_id, 1 + doc_id % 5 // 4 AS version, CASE WHEN doc_id % 3 = 0 THEN 'gone' ELSE substr(text, 11, 50) END AS text FROM documents)
SELECT id, fault FROM (SELECT m.id, CASE WHEN d.text IS NULL THEN 'removed' WHEN m.version <> 1 THEN 'new_version' WHEN substr(d.text, 11, length(m.text)) <> m.text THEN 'text_differs' END AS fault FROM m LEFT JOIN documents d ON d.doc_id = m.doc_id) WHERE fault IS NOT NULL""")
def pl10(spark, d):
    i, docs = F.col("doc_id"), B.documents(spark, d)
    m = docs.select(i.alias("id"), F.when(i % 8 == 0, -1).otherwise(i).alias("doc_id"), F.when(i % 5 == 4, 2).otherwise(1).alias("version"), F.lit(10).alias("start"), F.when(i % 3 == 0, "gone").otherwise(F.substring("text", 11, 50)).alias("text"))
    return L.stale_sources(m, docs.select("doc_id", F.lit(1).alias("version"), F.col("text").alias("content")))


@query("PL7_evidence_edit", """WITH e AS (SELECT l_orderkey AS plan, l_linenumber AS unit, l_partkey AS chunk FROM lineitem), x AS (SELECT DISTINCT plan, unit, chunk FROM (SELECT plan, unit, chunk FROM e WHERE NOT (unit % 3 = 0) UNION ALL SELECT plan, unit, chunk + 1 FROM e WHERE unit % 3 = 0))
SELECT plan, count(DISTINCT unit) AS units, count(DISTINCT chunk) AS covered FROM x GROUP BY plan""")
def pl7(spark, d):
    """Units whose evidence is set by hand lose what they had; coverage is counted again."""
    e = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("unit"), F.col("l_partkey").alias("chunk"))
    edits = e.filter("unit % 3 = 0").select("plan", "unit", (F.col("chunk") + 1).alias("chunk"))
    left = e.join(edits.select("plan", "unit").distinct(), ["plan", "unit"], "left_anti").unionByName(edits).distinct()
    return left.groupBy("plan").agg(F.count_distinct("unit").alias("units"), F.count_distinct("chunk").alias("covered"))


@query("PL13_confirm_log", _PLAN + "SELECT u.plan, u.unit, CASE WHEN NOT selected THEN 'skipped' WHEN dr.status IS NULL THEN 'missing' WHEN dr.status = 'confirmed' THEN 'already_confirmed' WHEN dr.status = 'passed' AND NOT undecided THEN 'confirmed' WHEN dr.status = 'passed' THEN 'undecided' ELSE 'not_ready' END AS result FROM u LEFT JOIN dr ON dr.plan = u.plan AND dr.unit = u.unit")
def pl13(spark, d):
    told = plan_units(spark, d).join(plan_drafts(spark, d), ["plan", "unit"], "left")
    s = F.col("status")
    result = F.when(~F.col("selected"), "skipped").when(s.isNull(), "missing").when(s == "confirmed", "already_confirmed").when((s == "passed") & ~F.col("undecided"), "confirmed").when(s == "passed", "undecided").otherwise("not_ready")
    return told.select("plan", "unit", result.alias("result"))
