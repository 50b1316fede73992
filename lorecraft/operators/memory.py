"""Learner memory: evidence, preferences with versions and scopes, interest sets, change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unit_evidence(units: DataFrame, snapshots: DataFrame, cards: DataFrame) -> DataFrame:
    """units(learner, unit) with where their mastery is known from: reviews, else card state, else nothing."""
    legacy = cards.groupBy("learner", "unit").agg(F.round(F.avg("mastery"), 6).alias("legacy_mastery"))
    told = units.join(snapshots.select("learner", "unit", "review_count", "mastery_level"), ["learner", "unit"], "left").join(legacy, ["learner", "unit"], "left")
    origin = F.when(F.col("review_count") > 0, "observed_review").when(F.col("legacy_mastery").isNotNull(), "legacy_card_state").otherwise("absent")
    return told.select("learner", "unit", origin.alias("origin"), "mastery_level", F.when(origin == "legacy_card_state", F.col("legacy_mastery")).alias("legacy_mastery"))


def recent(events: DataFrame, by: str, since_ms: int, most: int) -> DataFrame:
    """Events not before since_ms, the newest `most` of each."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("ms").desc(), F.col("id").desc()))
    return events.filter(F.col("ms") >= since_ms).withColumn("place", place).filter(F.col("place") <= most)


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, with the number of rows it stands for."""
    w = Window.partitionBy(*key)
    told = rows.withColumn("_p", F.row_number().over(w.orderBy(*order))).withColumn("copies", F.count("*").over(w))
    return told.filter("_p = 1").drop("_p")


def preferences(changes: DataFrame) -> DataFrame:
    """(learner, category, scope_key, value, version): the latest change of each key, and how many there were."""
    return changes.groupBy("learner", "category", "scope_key").agg(F.max_by("value", F.struct("ms", "id")).alias("value"), F.count("*").alias("version"))


def reconciled(current: DataFrame, desired: DataFrame, key: list[str]) -> DataFrame:
    """What makes current(key, enabled) into the set desired(key): insert, enable, disable or keep."""
    both = current.join(desired.withColumn("wanted", F.lit(True)), key, "full")
    wanted, there, on = F.coalesce("wanted", F.lit(False)), F.col("enabled").isNotNull(), F.coalesce("enabled", F.lit(False))
    action = F.when(wanted & ~there, "insert").when(wanted & ~on, "enable").when(~wanted & on, "disable").otherwise("keep")
    return both.select(*key, action.alias("action"))


def revision(items: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(by, revision): a digest of the sorted items of each."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in fields])
    return items.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("revision"))


def changed(old: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """(key, before, after) of rows in both whose field differs, null-safely."""
    both = old.select(key, F.col(field).alias("before")).join(new.select(key, F.col(field).alias("after")), key)
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def memory_versions(events: DataFrame) -> DataFrame:
    """events with the version of the learner's memory: how many changes came so far."""
    w = Window.partitionBy("learner").orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("version", F.sum(F.col("changes").cast("int")).over(w))


def scoped(preferences: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(learner, topic, unit) with the value that holds: of the unit, else the topic, else everywhere; the latest of equals."""
    rank = F.when(F.col("scope") == "unit", 3).when(F.col("scope") == "topic", 2).otherwise(1)
    p = preferences.select("learner", "scope", "scope_id", "value", "ms", "id", rank.alias("_rank"))
    # each scope is an equi-join of its own, so no pair is tried that can't match
    parts = [
        targets.join(p.filter(F.col("scope") == s), [targets["learner"] == p["learner"], *([p["scope_id"] == targets[c]] if c else [])]).select(targets["learner"], targets["topic"], targets["unit"], "value", "_rank", "ms", "id")
        for s, c in (("unit", "unit"), ("topic", "topic"), ("global", None))
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = both.groupBy("learner", "topic", "unit").agg(F.max_by("value", F.struct("_rank", "ms", "id")).alias("value"))
    return targets.join(best, ["learner", "topic", "unit"], "left")
