"""Recommendation candidates: similarity, near duplicates, scores, exclusions and diverse picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorecraft.functions import text as X

NEAR = 0.7
# Weights of the score.
WEIGHTS = {"source": 18, "card": 8, "novelty": 18, "difficulty": 24, "downrank": 80, "familiarity": 70, "diversity": 35}
LEVELS = ["foundation", "standard", "challenge"]


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def lexical_similarity(a: Column, b: Column) -> Column:
    """Shared bigrams over the root of both numbers; 0 where one has none."""
    return F.coalesce(F.try_divide(overlap(a, b), F.sqrt(F.size(a) * F.size(b))), F.lit(0.0))


def coverage(required: Column, actual: Column) -> Column:
    """Share of the required bigrams that are there; 1 where none are required."""
    return F.when(F.size(required) == 0, F.lit(1.0)).otherwise(overlap(required, actual) / F.size(required))


def is_near(a: Column, b: Column, ga: Column, gb: Column) -> Column:
    """Equal, one within the other at 12 characters or more, or 0.7 of the smaller bigram set shared."""
    inside = (F.least(F.length(a), F.length(b)) >= 12) & (F.contains(a, b) | F.contains(b, a))
    return (a != "") & (b != "") & ((a == b) | inside | (overlap(ga, gb) >= NEAR * F.greatest(F.lit(1), F.least(F.size(ga), F.size(gb)))))


def near_duplicates(items: DataFrame, key: str, text: Column) -> DataFrame:
    """(a, b): all near-duplicate pairs of items, a < b, by classes of equal text.

    A pair shares 0.7 of the smaller bigram set, or all of it where one text lies within the
    other. So of the smaller set's bigrams, the rarest first, some of the first 0.3 and one is in
    the larger set: those few are joined with all bigrams of the others, which loses no pair.
    """
    classes = items.select(F.col(key).alias("id"), text.alias("t")).filter("t <> ''").groupBy("t").agg(F.min("id").alias("id"))
    told = classes.select("id", "t", X.grams(F.col("t")).alias("g")).withColumn("n", F.size("g"))
    every = told.select("id", "n", F.explode("g").alias("gram"))
    common = every.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = every.join(common, "gram").withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("df", "gram")))
    first = ranked.filter(F.col("_r") <= F.col("n") - F.ceil(NEAR * F.col("n")) + 1).select("gram", F.col("id").alias("x"), F.col("n").alias("nx"))
    met = first.join(every, "gram").filter((F.col("x") != F.col("id")) & (F.col("nx") <= F.col("n")))
    pairs = met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    side = lambda n: told.select(F.col("id").alias(n), F.col("t").alias(f"t{n}"), F.col("g").alias(f"g{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(is_near(F.col("ta"), F.col("tb"), F.col("ga"), F.col("gb"))).select("a", "b")


def confusion(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(detected, missed, false_positives) of pairs (a, b) against the true ones: one row."""
    told = found.withColumn("_f", F.lit(True)).join(truth.withColumn("_t", F.lit(True)), ["a", "b"], "full")
    f, t = F.coalesce("_f", F.lit(False)), F.coalesce("_t", F.lit(False))
    return told.agg(F.count_if(f & t).alias("detected"), F.count_if(~f & t).alias("missed"), F.count_if(f & ~t).alias("false_positives"))


def scored(candidates: DataFrame) -> DataFrame:
    """candidates(base, evidence, novelty_similarity, has_base, difficulty, target, downranked, familiar) with score components and score."""
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(c))
    w = WEIGHTS
    parts = {
        "source_part": F.when(F.col("evidence") == "saved_source", w["source"]).when(F.col("evidence") == "card_extension", w["card"]).otherwise(0),
        "novelty_part": F.when(F.col("has_base"), F.round(w["novelty"] * (1 - F.col("novelty_similarity")))).otherwise(0).cast("int"),
        "difficulty_part": F.when(F.col("target").isNull(), 0).otherwise(-w["difficulty"] * F.abs(place("difficulty") - place("target"))).cast("int"),
        "downrank_part": F.when(F.col("downranked"), -w["downrank"]).otherwise(0),
        "familiarity_part": F.when(F.col("familiar") & (F.col("difficulty") == "foundation"), -w["familiarity"]).otherwise(0),
    }
    told = candidates.withColumns(parts)
    return told.withColumn("score", (F.col("base") + sum((F.col(c) for c in parts), F.lit(0))).cast("int"))


def unseen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates whose concept or signature nobody of seen(learner, key) had."""
    for c in ("concept", "signature"):
        candidates = candidates.join(seen.select("learner", F.col("key").alias(c)).distinct(), ["learner", c], "left_anti")
    return candidates


def seeds(interests: DataFrame, weak: DataFrame, cards: DataFrame) -> DataFrame:
    """(learner, seed, kind, score): up to 4 interests, 3 weak units, 5 recent cards and one exploration seed of each learner."""
    def best(rows: DataFrame, order: list, most: int, kind: str, base: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("learner").orderBy(*order)) - 1
        return rows.withColumn("p", place).filter(F.col("p") < most).select("learner", F.col("seed").cast("string").alias("seed"), F.lit(kind).alias("kind"), (F.lit(base) - F.col("p")).alias("score"))

    parts = best(interests, [F.col("ms").desc(), "seed"], 4, "interest", 120).unionByName(best(weak, [F.col("incorrect_count").desc(), F.col("last_reviewed_ms").desc(), "seed"], 3, "weak_unit", 100))
    parts = parts.unionByName(best(cards, [F.col("ms").desc(), "seed"], 5, "recent_card", 82))
    explore = parts.select("learner").distinct().select("learner", F.lit("explore").alias("seed"), F.lit("exploration").alias("kind"), F.lit(48).alias("score"))
    return parts.unionByName(explore)


def funnel(events: DataFrame) -> DataFrame:
    """(candidate, exposed, opened, saved, open_rate): each event id counts once."""
    own = events.dropDuplicates(["id"])
    told = own.groupBy("candidate").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in (("exposed", "view"), ("opened", "click"), ("saved", "purchase"))])
    return told.withColumn("open_rate", F.round(F.try_divide(F.col("opened"), F.col("exposed")), 6))


def feedback_status(candidates: DataFrame, feedback: DataFrame) -> DataFrame:
    """(candidate, status) of candidates(candidate, status): what the latest feedback makes of each.

    A dismissed one is dismissed; one that is liked is available, unless it was opened or saved;
    any other feedback is applied and takes it off.
    """
    last = feedback.groupBy("candidate").agg(F.max_by("action", F.struct("ms", "id")).alias("action"))
    liked = F.when(F.col("status").isin("opened", "saved"), F.col("status")).otherwise("available")
    status = F.when(F.col("action").isNull(), F.col("status")).when(F.col("action") == "dismiss", "dismissed").when(F.col("action") == "like", liked).otherwise("feedback_applied")
    return candidates.join(last, "candidate", "left").select("candidate", status.alias("status"))
