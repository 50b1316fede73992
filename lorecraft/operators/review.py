"""Mastery, streaks, schedules and due queues from the append-only log of answers.

Answers have learner, unit, id, exercise, correct, hint_used, answered_at and ms (answered_at
in epoch milliseconds). Ties in time are ordered by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["learner", "unit"]
DAY_MS = 86_400_000
# Days until the next review by the streak before the answer.
INTERVALS = [1, 3, 7, 14, 30]
MASTERY_RANK = {"insufficient_evidence": 0, "learning": 1, "familiar": 3, "multiple_verified": 5}


def breaks_streak() -> Column:
    """Whether an answer ends a streak of correct answers without a hint; an unknown hint counts as none."""
    return ~F.coalesce(F.col("correct"), F.lit(False)) | F.coalesce(F.col("hint_used"), F.lit(False))


def streaks(answers: DataFrame) -> DataFrame:
    """answers with prior_streak (before the answer) and streak (with it), in one shuffle by learner and unit."""
    order = Window.partitionBy(*KEY).orderBy("ms", "id")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    part = Window.partitionBy(*KEY, "_part").orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    told = answers.withColumn("_bad", breaks_streak()).withColumn("_part", F.sum(F.col("_bad").cast("int")).over(running))
    told = told.withColumn("streak", F.sum((~F.col("_bad")).cast("long")).over(part))
    return told.withColumn("prior_streak", F.coalesce(F.lag("streak").over(order), F.lit(0)).cast("long")).drop("_bad", "_part")


def schedule(answers: DataFrame) -> DataFrame:
    """streaks with interval_days and due_ms: one day after a wrong or hinted answer, else longer with the streak before."""
    longer = F.get(F.array(*[F.lit(d) for d in INTERVALS]), F.least(F.col("prior_streak"), F.lit(len(INTERVALS) - 1)).cast("int"))
    told = streaks(answers).withColumn("interval_days", F.when(breaks_streak(), F.lit(INTERVALS[0])).otherwise(longer))
    return told.withColumn("due_ms", F.col("ms") + F.col("interval_days").cast("long") * F.lit(DAY_MS))


def level(reviews: Column, correct: Column, unhinted: Column, exercises: Column, streak: Column, last_correct: Column) -> Column:
    return (
        F.when((correct >= 3) & (unhinted >= 3) & (exercises >= 2) & (streak >= 2), "multiple_verified")
        .when((correct >= 2) & (unhinted >= 2) & last_correct, "familiar")
        .when(reviews > 0, "learning")
        .otherwise("insufficient_evidence")
    )


def evidence_state(reviews: Column, mastery: Column, accuracy: Column) -> Column:
    return (
        F.when(reviews == 0, "insufficient_evidence").when(reviews < 2, "limited_evidence").when(mastery == "multiple_verified", "multiple_verified")
        .when(accuracy >= 0.8, "recently_successful").when(accuracy >= 0.45, "mixed_evidence").otherwise("needs_support")
    )


def mastery(answers: DataFrame) -> DataFrame:
    """Snapshot by learner and unit: counts, accuracy, streak, level, evidence state and last review.

    Only answers known to be right or wrong count. The streak reads the last state of a
    running window, so windows and aggregates share the shuffle by learner and unit.
    """
    good = F.col("correct") & ~F.coalesce(F.col("hint_used"), F.lit(False))
    last = F.struct("ms", "id")
    told = streaks(answers.filter(F.col("correct").isNotNull())).groupBy(*KEY).agg(
        F.count("*").alias("review_count"), F.count_if("correct").alias("correct_count"), F.count_if(~F.col("correct")).alias("incorrect_count"),
        F.count_if(good).alias("no_hint_correct_count"), F.count_if(F.coalesce("hint_used", F.lit(False))).alias("hint_used_count"),
        F.count_distinct("exercise").alias("exercise_count"), F.max_by("streak", last).alias("consecutive_no_hint_correct"),
        F.max_by("correct", last).alias("last_correct"), F.max("ms").alias("last_reviewed_ms"),
    )
    told = told.withColumn("accuracy", F.round(F.col("correct_count") / F.col("review_count"), 6))
    told = told.withColumn(
        "mastery_level", level(*[F.col(c) for c in ("review_count", "correct_count", "no_hint_correct_count", "exercise_count", "consecutive_no_hint_correct", "last_correct")])
    )
    return told.withColumn("evidence_state", evidence_state(F.col("review_count"), F.col("mastery_level"), F.col("correct_count") / F.col("review_count")))


def legacy_mastery(level: Column) -> Column:
    return reduce(lambda c, kv: c.when(level == kv[0], kv[1]), MASTERY_RANK.items(), F).otherwise(0)


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """(event_id, error_type): the last correction of each answer; equal times by the larger id."""
    return corrections.groupBy("event_id").agg(F.max_by("error_type", F.struct("corrected_ms", "id")).alias("corrected_type"))


def error_causes(answers: DataFrame, corrections: DataFrame) -> DataFrame:
    """(learner, unit, error_cause) of the latest wrong answer: a correction, else what was recorded, else unknown; none without one."""
    told = answers.join(latest_corrections(corrections), answers["id"] == F.col("event_id"), "left")
    cause = F.coalesce("corrected_type", "error_type", F.lit("unknown"))
    wrong = ~F.col("correct")
    return told.groupBy(*KEY).agg(F.coalesce(F.max_by(F.when(wrong, cause), F.when(wrong, F.struct("ms", "id"))), F.lit("none")).alias("error_cause"))


def latest_state(answers: DataFrame) -> DataFrame:
    """(learner, unit, due_ms, interval_days, last_ms): the schedule after the latest answer."""
    last = F.struct("ms", "id")
    return schedule(answers).groupBy(*KEY).agg(F.max_by("due_ms", last).alias("due_ms"), F.max_by("interval_days", last).alias("interval_days"), F.max("ms").alias("last_ms"))


def due_queue(units: DataFrame, active: DataFrame, deferred: DataFrame, now_ms: int) -> DataFrame:
    """Due units of each learner in order: those with an open attempt, then units other than the last one, lower mastery, earlier due, unit.

    units(learner, unit, due_ms, mastery_level, last_unit); active(learner, unit); deferred(learner, unit, until_ms).
    """
    held = deferred.filter(F.col("until_ms") > now_ms).select(*KEY).distinct()
    due = units.filter(F.col("due_ms") <= now_ms).join(held, KEY, "left_anti").join(active.select(*KEY).distinct().withColumn("is_active", F.lit(True)), KEY, "left")
    due = due.withColumn("is_active", F.coalesce("is_active", F.lit(False))).withColumn("rank_level", legacy_mastery(F.col("mastery_level")))
    order = [F.col("is_active").desc(), (F.col("unit") == F.col("last_unit")).asc(), "rank_level", "due_ms", "unit"]
    return due.withColumn("position", F.row_number().over(Window.partitionBy("learner").orderBy(*order)))


def day_state(answers: DataFrame) -> DataFrame:
    """(learner, day, answered, last_unit): what was answered on each day."""
    return answers.groupBy("learner", F.date_format("answered_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("answered"), F.max_by("unit", F.struct("ms", "id")).alias("last_unit")
    )


def daily_goal(value: Column) -> Column:
    """A goal from 1 to 20; 3 where there is none."""
    return F.when(value.isNull(), F.lit(3)).otherwise(F.greatest(F.lit(1), F.least(F.lit(20), F.floor(value)))).cast("int")


def overview(queue: DataFrame, days: DataFrame, learners: DataFrame, day: str) -> DataFrame:
    """A row for each learner: due units, head of the queue, answers of the day, what remains to the goal, status."""
    heads = queue.groupBy("learner").agg(F.count("*").alias("due"), F.min_by("unit", "position").alias("head_unit"))
    today = days.filter(F.col("day") == day).select("learner", "answered")
    told = learners.join(heads, "learner", "left").join(today, "learner", "left").fillna(0, ["due", "answered"])
    goal = daily_goal(F.col("goal"))
    status = F.when(F.col("answered") >= goal, "goal_reached").when(F.col("due") == 0, "nothing_due").otherwise("ready")
    return told.select("learner", "due", "head_unit", "answered", goal.alias("daily_goal"), F.greatest(goal - F.col("answered"), F.lit(0)).alias("remaining"), status.alias("status"))


def rotation(exercises: DataFrame, answers: DataFrame) -> DataFrame:
    """exercises(unit, exercise, derived) of each learner in turn: never used first, saved before derived, least recently used, id."""
    used = answers.groupBy("learner", "exercise").agg(F.max("ms").alias("last_used_ms"))
    told = answers.select("learner", "unit").distinct().join(exercises, "unit").join(used, ["learner", "exercise"], "left")
    order = Window.partitionBy("learner", "unit").orderBy(F.col("last_used_ms").isNotNull(), "derived", "last_used_ms", "exercise")
    return told.withColumn("turn", F.row_number().over(order))


def enriched(answers: DataFrame) -> DataFrame:
    """schedule with the running number of answers of the day and mastery after each answer."""
    day = Window.partitionBy("learner", "day").orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    running = Window.partitionBy(*KEY).orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    told = schedule(answers).withColumn("day", F.date_format("answered_at", "yyyy-MM-dd"))
    good = F.col("correct") & ~F.coalesce(F.col("hint_used"), F.lit(False))
    after = level(
        F.count("*").over(running), F.sum(F.col("correct").cast("int")).over(running), F.sum(good.cast("int")).over(running),
        F.size(F.collect_set("exercise").over(running)), F.col("streak"), F.col("correct"),
    )
    return told.withColumn("mastery_after", after).withColumn("daily_answered_after", F.count("*").over(day))


def idempotent(mutations: DataFrame) -> DataFrame:
    """(id, copies, conflict, kept): mutations(id, fingerprint, seq); one id with two fingerprints is a conflict, the first copy is kept."""
    return mutations.groupBy("id").agg(
        F.count("*").alias("copies"), (F.count_distinct("fingerprint") > 1).alias("conflict"), F.min_by("fingerprint", "seq").alias("kept")
    )


def deferred_until(kind: Column, at: Column) -> Column:
    """later: in an hour; tomorrow: 8 o'clock of the next day; skip_today: the next midnight."""
    midnight = F.date_trunc("day", at) + F.expr("INTERVAL 1 DAY")
    return F.when(kind == "later", at + F.expr("INTERVAL 1 HOUR")).when(kind == "tomorrow", midnight + F.expr("INTERVAL 8 HOURS")).otherwise(midnight)


def staggered(cards: DataFrame, group: str, order: str, goal: int, now_ms: int) -> DataFrame:
    """cards with release_ms: as many of a group as the goal on each following day."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return cards.withColumn("release_ms", F.lit(now_ms) + (1 + F.floor(place / F.lit(goal))).cast("long") * F.lit(DAY_MS))


def retained(attempts: DataFrame, now_ms: int, days: int, most: int) -> DataFrame:
    """attempts(learner, id, ms, active) of the last `days` or active, and of them the newest `most` of each learner."""
    young = attempts.filter((F.col("ms") >= F.lit(now_ms - days * DAY_MS)) | F.col("active"))
    place = F.row_number().over(Window.partitionBy("learner").orderBy(F.col("ms").desc(), F.col("id").desc()))
    return young.withColumn("place", place).filter(F.col("place") <= most)


def matching(answers: DataFrame, cards: DataFrame) -> DataFrame:
    """(card_id, events): answers of each card, by its id or its unit; one that matches both ways counts once."""
    by_unit = cards.join(answers, cards["unit_ref"] == answers["unit"]).select("card_id", "id")
    by_card = cards.join(answers, cards["card_id"] == answers["exercise"]).select("card_id", "id")
    return by_unit.unionByName(by_card).distinct().groupBy("card_id").agg(F.count("*").alias("events"))


def exercise_as_of(attempts: DataFrame, versions: DataFrame) -> DataFrame:
    """attempts(id, exercise, ms) with the version of versions(exercise, version, from_ms) that held then."""
    both = attempts.join(versions, "exercise").filter(F.col("from_ms") <= F.col("ms"))
    return both.groupBy("id").agg(F.max_by("version", F.struct("from_ms", "version")).alias("version"))
