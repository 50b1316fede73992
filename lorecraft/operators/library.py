"""Review flow, preferences, recommendation pools and plans as relational steps.

Each step is one shuffle on its own key, or none; a latest row is an aggregate by max_by and a
top-k a row_number filter, which Spark pushes below the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
# What feedback on a recommendation says about preferences, and the order of scopes.
FEEDBACK = {
    "like_topic": ("topic_interest", None), "less_topic": ("topic_downrank", None), "exclude_unit": ("unit_exclusion", None), "already_familiar": ("self_familiarity", None),
    "too_simple": ("difficulty_preference", "advanced"), "too_hard": ("difficulty_preference", "foundational"),
}
SCOPE_RANK = {"unit": 3, "topic": 2, "global": 1}
ATTEMPT_STATES = ["active", "answered", "abandoned"]
POOL_VERSION = "discovery-pool-v2.1"
POOLS_KEPT, SEEN_KEYS, SEEN_TARGETS, MAX_SEEDS = 20, 120, 80, 10
HIDDEN = ["dismissed", "feedback_applied"]


def first_rows(rows: DataFrame, by: list[str], order: list, k: int = 1, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def chosen(values: Column, *names: tuple[str, str]) -> Column:
    return reduce(lambda c, n: c.when(values == n[0], n[1]), names, F)


# ---- review


def graded(attempts: DataFrame) -> DataFrame:
    """attempts with `correct` and `fault`: a choice by its index, a recall by the learner's own word after the answer was shown.

    attempts(kind, options, correct_index, chosen, self_assessed, revealed, status).
    """
    recall, n = F.col("kind") == "recall", F.size("options")
    fault = (
        F.when(F.col("status") != "active", "already_answered").when(recall & ~F.coalesce("revealed", F.lit(False)), "not_revealed").when(recall & F.col("self_assessed").isNull(), "not_assessed")
        .when(~recall & (F.col("chosen").isNull() | (F.col("chosen") < 0) | (F.col("chosen") >= n)), "not_answered")
    )
    correct = F.when(recall, F.col("self_assessed")).otherwise(F.col("chosen") == F.col("correct_index"))
    return attempts.withColumn("fault", fault).withColumn("correct", F.when(F.col("fault").isNull(), correct))


def choice_cause(correct: Column, text: Column, classify) -> Column:
    """Cause of a wrong choice by the misconception of that option; unknown where none was written."""
    return F.when(correct, "none").when(F.trim(F.coalesce(text, F.lit(""))) == "", "unknown").otherwise(classify(text))


def active_state(attempts: DataFrame, deferrals: DataFrame, key: list[str], now: int) -> DataFrame:
    """(key, attempt, until): the latest open attempt, and the latest deferral that still holds."""
    a = attempts.filter("status = 'active'").groupBy(*key).agg(F.max_by("id", F.struct("ms", "id")).alias("attempt"))
    u = deferrals.filter(F.col("until") > now).groupBy(*key).agg(F.max_by("until", F.struct("ms", "id")).alias("until"))
    return a.join(u, key, "full")


def staged(cards: DataFrame, now: int) -> DataFrame:
    """New cards whose first lesson is still to come, by learner in order of their day: position from 1."""
    own = cards.filter((F.col("stage") == "new") & F.col("completed_at").isNull() & (F.col("due_ms") > now))
    return own.withColumn("position", F.row_number().over(Window.partitionBy("learner").orderBy("due_ms", "id")))


def released(cards: DataFrame, now: int) -> DataFrame:
    """The one staged card of each learner without anything due: it becomes due now."""
    free = cards.groupBy("learner").agg(F.bool_or((F.col("due_ms") <= now) & F.col("completed_at").isNull()).alias("busy")).filter("NOT busy")
    return staged(cards, now).filter("position = 1").join(free.select("learner"), "learner", "left_semi").select("learner", "id", F.lit(now).alias("due_ms"))


def reasons(snapshots: DataFrame) -> DataFrame:
    """snapshots with `reasons`: a recent error of a known kind comes before being due."""
    error = (F.col("incorrect_count") > 0) & (F.col("error_type") != "none")
    return snapshots.withColumn("reasons", F.when(error, F.array(F.lit("recent_error"), F.lit("due_card"))).otherwise(F.array(F.lit("due_card"))))


def review_difficulty(level: Column, preference: Column) -> Column:
    by_level = F.when(level == "multiple_verified", "challenge").when(level == "familiar", "standard").otherwise("foundation")
    return F.when(preference == "foundational", "foundation").when(preference == "advanced", "challenge").otherwise(by_level)


def corrections_log(corrections: DataFrame, events: DataFrame) -> DataFrame:
    """Each correction with the type that held before it: that of the correction before, else of the event."""
    order = Window.partitionBy("event_id").orderBy("ms", "id")
    return corrections.withColumn("_before", F.lag("to_type").over(order)).join(events.select("event_id", "error_type"), "event_id").select("id", "event_id", F.coalesce("_before", "error_type").alias("from_type"), "to_type")


def due_list(cards: DataFrame, now: int, today: str) -> DataFrame:
    """Cards without a due time or past it, and not answered rightly today, in order."""
    at = F.coalesce("due_ms", F.lit(0))
    own = cards.filter(((at == 0) | (at <= now)) & ~F.coalesce(F.col("last_correct_day") == today, F.lit(False)))
    return own.withColumn("position", F.row_number().over(Window.partitionBy("learner").orderBy(at, "unit")))


# ---- preferences and memory


def feedback_preferences(feedback: DataFrame) -> DataFrame:
    """(id, category, value): the preference that each known action stands for; others are refused."""
    action = F.col("action")
    category = chosen(action, *[(a, c) for a, (c, _) in FEEDBACK.items()])
    fixed = chosen(action, *[(a, v) for a, (_, v) in FEEDBACK.items() if v])
    label = F.nullif(F.col("topic"), F.lit(""))
    value = F.coalesce(fixed, F.when(action.isin("exclude_unit", "already_familiar"), F.coalesce(label, F.col("unit"))).otherwise(label))
    return feedback.filter(action.isin(list(FEEDBACK))).select("id", category.alias("category"), value.alias("value"))


def by_scope(preferences: DataFrame, key: str, k: int) -> DataFrame:
    """The k enabled preferences of each key: unit before topic before global, then the latest."""
    rank = chosen(F.col("scope_type"), *[(s, str(r)) for s, r in SCOPE_RANK.items()]).cast("int")
    return first_rows(preferences.filter("enabled"), [key], [rank.desc(), F.col("updated_ms").desc(), "id"], k)


def candidate_memory(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates(id, eligible, status) after decisions(id, confirm): only eligible pending ones change."""
    told = candidates.join(decisions, "id", "left")
    change = F.col("eligible") & (F.col("status") == "pending") & F.col("confirm").isNotNull()
    return told.select("id", F.when(change, F.when(F.col("confirm"), "confirmed").otherwise("ignored")).otherwise(F.col("status")).alias("status"))


# ---- recommendation


def weak_units(snapshots: DataFrame, k: int = 3) -> DataFrame:
    """The k units of each learner that are not verified yet, most wrong answers first, then the latest."""
    return first_rows(snapshots.filter("mastery_level <> 'multiple_verified'"), ["learner"], [F.col("incorrect_count").desc(), F.col("last_reviewed_ms").desc(), "unit"], k)


def interests_by_exposure(interests: DataFrame, exposures: DataFrame) -> DataFrame:
    """interests(learner, seed) in the order of their last exposure, never exposed first, longest ago next.

    exposures(learner, seed, pool): pool counts from 0, the newest.
    """
    last = exposures.groupBy("learner", "seed").agg(F.min("pool").alias("pool"))
    order = Window.partitionBy("learner").orderBy(F.col("pool").desc_nulls_first(), "seed")
    return interests.join(last, ["learner", "seed"], "left").withColumn("position", F.row_number().over(order))


def capped_seeds(seeds: DataFrame, force: DataFrame) -> DataFrame:
    """Seeds(learner, seed, place, kind, score): the last of each seed at its first place, ten at most, with the exploration one.

    force(learner): learners whose exploration seed moves to the third place.
    """
    one = seeds.groupBy("learner", "seed").agg(F.min("place").alias("first"), F.max_by(F.struct("kind", "score"), "place").alias("s")).select("learner", "seed", "first", "s.*")
    w = Window.partitionBy("learner")
    told = one.withColumn("n", F.row_number().over(w.orderBy("first"))).withColumn("all", F.count("*").over(w))
    last = F.col("n") == F.col("all")
    kept = told.filter((F.col("n") < MAX_SEEDS) | last).join(force.withColumn("_f", F.lit(True)), "learner", "left")
    order = F.when(last & F.col("_f"), F.lit(2.5)).otherwise(F.col("n").cast("double"))
    return kept.withColumn("position", F.row_number().over(w.orderBy(order, "n"))).select("learner", "seed", "kind", "score", "position")


def preference_flags(candidates: DataFrame, preferences: DataFrame) -> DataFrame:
    """candidates(learner, id, unit, topic) with downranked, excluded, familiar and the number of preferences that apply.

    preferences(learner, category, scope_type, scope_id): a global one applies to all, others by unit or topic.
    """
    hit = (F.col("scope_type") == "global") | ((F.col("scope_type") == "unit") & (F.col("scope_id") == F.col("unit"))) | ((F.col("scope_type") == "topic") & (F.col("scope_id") == F.col("topic")))
    told = candidates.join(preferences, "learner", "left").withColumn("_c", F.when(hit, F.col("category")))
    flag = lambda c: F.coalesce(F.bool_or(F.col("_c") == c), F.lit(False))
    return told.groupBy("learner", "id").agg(flag("topic_downrank").alias("downranked"), flag("unit_exclusion").alias("excluded"), flag("self_familiarity").alias("familiar"), F.count("_c").alias("applied"))


def seen_memory(exposed: DataFrame, k: int = SEEN_KEYS) -> DataFrame:
    """The last k distinct keys that each session has seen, by when they were last added."""
    return first_rows(exposed.groupBy("session", "key").agg(F.max("ms").alias("ms")), ["session"], [F.col("ms").desc(), "key"], k)


def reusable_pools(pools: DataFrame, now: int) -> DataFrame:
    """The newest pool of each learner that can be shown again: current version and memory, open, less than a day old."""
    own = pools.filter((F.col("version") == POOL_VERSION) & F.col("status").isin("active", "empty") & (F.col("memory_version") == F.col("current_memory")) & (F.lit(now) - F.col("created_ms") < DAY_MS))
    return first_rows(own, ["learner"], [F.col("created_ms").desc(), "id"]).drop("rank")


def kept_pools(pools: DataFrame, refreshed: DataFrame, k: int = POOLS_KEPT) -> DataFrame:
    """The newest k pools of each learner; those of refreshed(id) are marked so."""
    newest = first_rows(pools, ["learner"], [F.col("created_ms").desc(), F.col("id").desc()], k)
    told = newest.join(refreshed.select("id").withColumn("_r", F.lit(True)), "id", "left")
    return told.withColumn("status", F.when(F.col("_r"), "refreshed").otherwise(F.col("status"))).drop("_r")


def gated_pools(pools: DataFrame) -> DataFrame:
    """Pools of another version that are open become stale."""
    old = (F.col("version") != POOL_VERSION) & F.col("status").isin("active", "empty")
    return pools.withColumn("status", F.when(old, "stale").otherwise(F.col("status")))


# ---- plans


def plan_coverage(units: DataFrame, drafts: DataFrame) -> DataFrame:
    """(plan, unit, status, reason) of the units that no decision has closed: of its draft, pending, or skipped with the reason.

    units(plan, unit, selected, skip_reason, disposition), drafts(plan, unit, status): one draft for a unit.
    """
    told = units.filter("disposition = 'active'").join(drafts.withColumnRenamed("status", "_draft"), ["plan", "unit"], "left")
    status = F.when(F.col("selected"), F.coalesce("_draft", F.lit("pending"))).otherwise("skipped")
    reason = F.when(F.col("selected"), "").otherwise(F.coalesce(F.nullif("skip_reason", F.lit("")), F.lit("not_selected")))
    return told.select("plan", "unit", status.alias("status"), reason.alias("reason"))


def worklist(units: DataFrame, drafts: DataFrame, most: int = 3) -> DataFrame:
    """The next units to be made for each plan: selected, active, decided, in order, not confirmed, most at a time (1 to 30)."""
    done = drafts.filter("status = 'confirmed' OR (has_card AND status <> 'generating')").select("plan", "unit")
    own = units.filter("selected AND disposition = 'active' AND NOT undecided").join(done, ["plan", "unit"], "left_anti")
    return first_rows(own, ["plan"], ["order", "unit"], max(1, min(30, most)), "position").select("plan", "unit", "position")


def retained_targets(units: DataFrame, drafts: DataFrame) -> DataFrame:
    confirmed = drafts.filter("status = 'confirmed'").select("plan", "unit")
    return units.filter("selected AND disposition = 'active' AND retained").join(confirmed, ["plan", "unit"], "left_anti").select("plan", "unit")


def discarded(units: DataFrame, relations: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of discarded plans: their confirmed units, and relations between two of them."""
    left = units.join(drafts.filter("status = 'confirmed'").select("plan", "unit"), ["plan", "unit"], "left_semi")
    end = lambda c: left.select("plan", F.col("unit").alias(c))
    return left, relations.join(end("from_unit"), ["plan", "from_unit"], "left_semi").join(end("to_unit"), ["plan", "to_unit"], "left_semi")


def stale_sources(materials: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, fault) of materials(id, doc_id, version, start, text) that documents(doc_id, version, content) no longer holds."""
    told = materials.join(documents.withColumnRenamed("version", "_v"), "doc_id", "left")
    same = F.substring(F.col("content"), F.col("start") + 1, F.length("text")) == F.col("text")
    fault = F.when(F.col("content").isNull(), "removed").when(F.col("_v") != F.col("version"), "new_version").when(~same, "text_differs")
    return told.select("id", fault.alias("fault")).filter("fault IS NOT NULL")
