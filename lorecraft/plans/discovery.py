"""Discovery queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.functions import text as X
from lorecraft.operators import discovery as D
from lorecraft.operators import review as R
from lorecraft.plans.registry import Registry
from lorecraft.plans.review import _STREAK
from lorecraft.plans.texts import semantic

query = Registry()


def _grams(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"


_B = f"WITH b AS (SELECT item_id, {semantic('text')} AS s, {semantic('substr(text, 1, 40)')} AS h FROM benchmark), g AS (SELECT *, {_grams('s')} AS g, {_grams('h')} AS gh FROM b), p AS (SELECT a.item_id, a.g AS ga, b.g AS gb, a.gh AS ha, a.s AS sa, b.s AS sb FROM g a JOIN g b ON b.item_id = a.item_id + 1)\n"


def _neighbours(spark, d):
    s = X.semantic_text(F.col("text"), clean=X.collapse)
    h = X.semantic_text(F.substring("text", 1, 40), clean=X.collapse)
    b = B.table(spark, d, "benchmark").select("item_id", s.alias("s"), h.alias("h")).select("item_id", "s", X.grams(F.col("s")).alias("ga"), X.grams(F.col("h")).alias("ha"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("sb"), F.col("ga").alias("gb"))
    return b.withColumnRenamed("s", "sa").join(other, "item_id")


@query("DS2_semantic_coverage", _B + "SELECT item_id, round(CASE WHEN len(ha) = 0 THEN 1 ELSE len(list_intersect(ha, gb)) / len(ha) END, 6) AS coverage FROM p")
def ds2(spark, d):
    return _neighbours(spark, d).select("item_id", F.round(D.coverage(F.col("ha"), F.col("gb")), 6).alias("coverage"))


@query("DS3_lexical_similarity", _B + "SELECT item_id, round(len(list_intersect(ga, gb)) / sqrt(len(ga) * len(gb)), 6) AS similarity FROM p")
def ds3(spark, d):
    return _neighbours(spark, d).select("item_id", F.round(D.lexical_similarity(F.col("ga"), F.col("gb")), 6).alias("similarity"))


_NEAR = "(a.s <> '' AND b.s <> '' AND (a.s = b.s OR (least(length(a.s), length(b.s)) >= 12 AND (contains(a.s, b.s) OR contains(b.s, a.s))) OR len(list_intersect(a.g, b.g)) >= 0.7::DOUBLE * greatest(1, least(len(a.g), len(b.g)))))"


@query("DS1_near_duplicates", f"WITH b AS (SELECT min(item_id) AS id, s FROM (SELECT item_id, {semantic('text')} AS s FROM benchmark) WHERE s <> '' GROUP BY s), g AS (SELECT *, {_grams('s')} AS g FROM b) SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id < b.id WHERE {_NEAR}")
def ds1(spark, d):
    b = B.table(spark, d, "benchmark")
    return D.near_duplicates(b, "item_id", X.semantic_text(F.col("text"), clean=X.collapse))


_COPIES = "SELECT item_id AS id, text FROM benchmark UNION ALL SELECT item_id + 100000, CASE item_id % 3 WHEN 0 THEN substr(text, 6) WHEN 1 THEN substr(text, 1, 40) || ' and quite another end of it' ELSE reverse(text) END FROM benchmark"


@query("EV7_duplicate_confusion", f"""WITH c AS ({_COPIES}), b AS (SELECT min(id) AS id, s FROM (SELECT id, {semantic('text')} AS s FROM c) WHERE s <> '' GROUP BY s), g AS (SELECT *, {_grams('s')} AS g FROM b), f AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id < b.id WHERE {_NEAR}),
t AS (SELECT item_id AS a, item_id + 100000 AS b FROM benchmark WHERE item_id % 3 = 0)
SELECT count(*) FILTER (WHERE f.a IS NOT NULL AND t.a IS NOT NULL) AS detected, count(*) FILTER (WHERE f.a IS NULL) AS missed, count(*) FILTER (WHERE t.a IS NULL) AS false_positives FROM f FULL JOIN t ON f.a = t.a AND f.b = t.b""")
def ev7(spark, d):
    """Each item with a cut copy (a duplicate), one with another end, or its mirror image."""
    i, b = F.col("item_id"), B.table(spark, d, "benchmark")
    changed = F.when(i % 3 == 0, F.substring(F.col("text"), F.lit(6), F.length("text"))).when(i % 3 == 1, F.concat(F.substring("text", 1, 40), F.lit(" and quite another end of it"))).otherwise(F.reverse("text"))
    items = b.select(i.alias("id"), "text").unionByName(b.select((i + 100000).alias("id"), changed.alias("text")))
    found = D.near_duplicates(items, "id", X.semantic_text(F.col("text"), clean=X.collapse))
    return D.confusion(found, b.filter("item_id % 3 = 0").select(i.alias("a"), (i + 100000).alias("b")))


def _candidates(spark, d):
    rv, x = B.review_events(spark, d), F.col("exercise")
    pick = lambda n, *v: F.get(F.array(*[F.lit(a) for a in v]), (x % n).cast("int"))
    return rv.select(
        "id", "learner", "unit", (F.lit(60) + x % 50).alias("base"), pick(3, "saved_source", "card_extension", "none").alias("evidence"), ((x % 11) / 10).alias("novelty_similarity"), (x % 4 != 0).alias("has_base"),
        pick(3, *D.LEVELS).alias("difficulty"), F.when(x % 5 != 0, F.get(F.array(*[F.lit(v) for v in D.LEVELS]), (F.col("unit") % 3).cast("int"))).alias("target"), (x % 7 == 0).alias("downranked"), (x % 2 == 0).alias("familiar"), "exercise",
    )


_CAND = B.RV_SQL + """, l AS (SELECT *, ['foundation', 'standard', 'challenge'] AS v FROM rv), c AS (SELECT id, learner, unit, exercise, 60 + exercise % 50 AS base, CASE exercise % 3 WHEN 0 THEN 18 WHEN 1 THEN 8 ELSE 0 END AS source_part,
 CASE WHEN exercise % 4 <> 0 THEN round(18 * (1 - (exercise % 11) / 10))::INT ELSE 0 END AS novelty_part, CASE WHEN exercise % 5 = 0 THEN 0 ELSE -24 * abs(exercise % 3 - unit % 3) END AS difficulty_part,
 CASE WHEN exercise % 7 = 0 THEN -80 ELSE 0 END AS downrank_part, CASE WHEN exercise % 2 = 0 AND exercise % 3 = 0 THEN -70 ELSE 0 END AS familiarity_part FROM l), sc AS (SELECT *, base + source_part + novelty_part + difficulty_part + downrank_part + familiarity_part AS score FROM c)
"""


@query("DS14_candidate_score", _CAND + "SELECT id, source_part, novelty_part, difficulty_part, downrank_part, familiarity_part, score FROM sc")
def ds14(spark, d):
    return D.scored(_candidates(spark, d)).select("id", "source_part", "novelty_part", "difficulty_part", "downrank_part", "familiarity_part", "score")


@query("DS18_seen_exclusion", B.RV_SQL + """, s AS (SELECT DISTINCT learner, CASE WHEN id % 2 = 0 THEN 'c' || exercise % 20 ELSE 's' || exercise % 33 END AS key FROM rv WHERE event_type = 'purchase')
SELECT id FROM rv WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.learner = rv.learner AND key = 'c' || exercise % 20) AND NOT EXISTS (SELECT 1 FROM s WHERE s.learner = rv.learner AND key = 's' || exercise % 33)""")
def ds18(spark, d):
    named = lambda p, n: F.concat(F.lit(p), (F.col("exercise") % n).cast("string"))
    rv = B.review_events(spark, d)
    seen = rv.filter("event_type = 'purchase'").select("learner", F.when(F.col("id") % 2 == 0, named("c", 20)).otherwise(named("s", 33)).alias("key"))
    return D.unseen(rv.select("id", "learner", named("c", 20).alias("concept"), named("s", 33).alias("signature")), seen).select("id")


@query("DS6_seeds", _STREAK + """, i AS (SELECT learner, seed, ms, row_number() OVER (PARTITION BY learner ORDER BY ms DESC, seed) - 1 AS p FROM (SELECT learner, unit AS seed, max(ms) AS ms FROM rv WHERE event_type = 'purchase' GROUP BY ALL)),
w AS (SELECT learner, unit AS seed, row_number() OVER (PARTITION BY learner ORDER BY incorrect_count DESC, last_reviewed_ms DESC, unit) - 1 AS p FROM mast WHERE mastery_level <> 'multiple_verified'),
k AS (SELECT learner, seed, row_number() OVER (PARTITION BY learner ORDER BY ms DESC, seed) - 1 AS p FROM (SELECT learner, exercise AS seed, max(ms) AS ms FROM rv GROUP BY ALL)),
a AS (SELECT learner, seed::VARCHAR AS seed, 'interest' AS kind, 120 - p AS score FROM i WHERE p < 4 UNION ALL SELECT learner, seed::VARCHAR, 'weak_unit', 100 - p FROM w WHERE p < 3 UNION ALL SELECT learner, seed::VARCHAR, 'recent_card', 82 - p FROM k WHERE p < 5)
SELECT * FROM a UNION ALL SELECT DISTINCT learner, 'explore', 'exploration', 48 FROM a""")
def ds6(spark, d):
    rv = B.review_events(spark, d)
    interests = rv.filter("event_type = 'purchase'").groupBy("learner", F.col("unit").alias("seed")).agg(F.max("ms").alias("ms"))
    weak = R.mastery(rv).filter("mastery_level <> 'multiple_verified'").select("learner", F.col("unit").alias("seed"), "incorrect_count", "last_reviewed_ms")
    return D.seeds(interests, weak, rv.groupBy("learner", F.col("exercise").alias("seed")).agg(F.max("ms").alias("ms")))


@query("DS20_pool_summary", B.RV_SQL + "SELECT unit AS pool, count(*) AS planned, count(*) FILTER (WHERE event_type = 'view') AS exposed, count(*) FILTER (WHERE event_type = 'click') AS opened, count(*) FILTER (WHERE event_type = 'purchase') AS saved, count(*) FILTER (WHERE event_type = 'error') AS failures FROM rv GROUP BY unit")
def ds20(spark, d):
    kinds = {"exposed": "view", "opened": "click", "saved": "purchase", "failures": "error"}
    return B.review_events(spark, d).groupBy(F.col("unit").alias("pool")).agg(F.count("*").alias("planned"), *[F.count_if(F.col("event_type") == k).alias(n) for n, k in kinds.items()])


@query("DS24_feedback_status", B.RV_SQL + """, f AS (SELECT exercise AS candidate, arg_max(CASE event_type WHEN 'click' THEN 'like' WHEN 'view' THEN 'less' WHEN 'error' THEN 'dismiss' ELSE 'exclude' END, (ms, id)) AS action FROM rv WHERE event_type <> 'purchase' AND learner % 5 = 0 GROUP BY exercise)
SELECT candidate, CASE WHEN action = 'dismiss' THEN 'dismissed' WHEN action IN ('less', 'exclude') THEN 'feedback_applied' WHEN action = 'like' AND status = 'active' THEN 'available' ELSE status END AS status
FROM (SELECT DISTINCT exercise AS candidate, ['saved', 'opened', 'available', 'available', 'active'][exercise % 5 + 1] AS status FROM rv) c LEFT JOIN f USING (candidate)""")
def ds24(spark, d):
    rv, kind = B.review_events(spark, d), F.col("event_type")
    action = F.when(kind == "click", "like").when(kind == "view", "less").when(kind == "error", "dismiss").otherwise("exclude")
    feedback = rv.filter((kind != "purchase") & (F.col("learner") % 5 == 0)).select(F.col("exercise").alias("candidate"), action.alias("action"), "ms", "id")
    status = F.get(F.array(*[F.lit(x) for x in ("saved", "opened", "available", "available", "active")]), F.col("candidate") % 5)
    return D.feedback_status(rv.select(F.col("exercise").alias("candidate")).distinct().withColumn("status", status), feedback)


@query("DS25_funnel", B.RV_SQL + "SELECT exercise AS candidate, count(*) FILTER (WHERE event_type = 'view') AS exposed, count(*) FILTER (WHERE event_type = 'click') AS opened, count(*) FILTER (WHERE event_type = 'purchase') AS saved, round(count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 6) AS open_rate FROM rv GROUP BY exercise")
def ds25(spark, d):
    rv = B.review_events(spark, d).select("id", F.col("exercise").alias("candidate"), F.col("event_type").alias("kind"))
    return D.funnel(rv.unionByName(rv.filter("id % 7 = 0")))
