"""Upkeep of cards, sources and drafts, checks of findings and verdicts, and gates of evaluations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# Fields that a finding may name, and claims that evidence may support.
FIELDS = r"^(?:card\.(?:title|learningObjective|summary|example\.text|boundaries|analogy|mantra)|exercise\.(?:question|answer|answerExplanation|(?:options|rubric|misconceptions)(?:\.\d+)?))$"
CLAIMS = ["summary", "exercise", "boundaries", "example"]
GATED = ["hit_at_1", "recall_at_3", "mrr_at_3", "no_hit_accuracy"]
MAX_P95_MS, MAX_BYTES, MAX_QUOTE, MAX_REASON = 200, 50_000_000, 1600, 1200


# ---- cards and sources


def card_defaults(cards: DataFrame) -> DataFrame:
    """cards with unit, schedule version and stage where they lack them."""
    stage = F.coalesce("stage", F.when(F.coalesce("review_count", F.lit(0)) > 0, "review").otherwise("scheduled"))
    return cards.select("id", F.coalesce("unit", F.concat(F.lit("unit_"), F.col("id").cast("string"))).alias("unit"), stage.alias("stage"), F.coalesce("schedule_version", F.lit("legacy-card-schedule")).alias("schedule_version"), F.coalesce("version", F.lit(1)).alias("version"))


def upserted_units(units: DataFrame, targets: DataFrame) -> DataFrame:
    """units(unit, topic, objective) with those of targets(unit, topic, objective, ms): the latest target wins, others stay."""
    new = targets.groupBy("unit").agg(F.max_by(F.struct("topic", "objective"), "ms").alias("t"))
    both = units.join(new, "unit", "full")
    return both.select("unit", F.coalesce("t.topic", "topic").alias("topic"), F.coalesce("t.objective", "objective").alias("objective"))


def source_ids(cards: DataFrame) -> DataFrame:
    """(id, source): the distinct sources of a card by its list, its snapshot and its citations."""
    every = F.concat(F.coalesce("sources", F.array().cast("array<string>")), F.array("snapshot"), F.coalesce("cited", F.array().cast("array<string>")))
    return cards.select("id", F.explode(F.array_distinct(F.array_compact(every))).alias("source"))


def attempt_status(status: Column) -> Column:
    return F.when(status.isin("active", "answered", "abandoned"), status).otherwise("abandoned")


def removed_source(documents: DataFrame, sources: DataFrame, materials: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after documents gone(doc_id) went: their rows go, sources are marked, finished copies lose their text."""
    mark = gone.select("doc_id").distinct().withColumn("_g", F.lit(True))
    s = sources.join(mark, "doc_id", "left").withColumn("status", F.when(F.col("_g"), "removed").otherwise(F.col("status"))).drop("_g")
    m = materials.join(mark, "doc_id", "left").withColumn("text", F.when(F.col("_g") & F.col("completed"), F.lit(None)).otherwise(F.col("text"))).drop("_g")
    return documents.join(mark, "doc_id", "left_anti"), s, m


def promoted(pending: DataFrame, library: DataFrame, opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(library, new) after pending cards were opened: each comes in once, whatever was sent twice."""
    own = pending.join(opened.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    new = own.join(library.select("id"), "id", "left_anti")
    return library.unionByName(new.select(*library.columns)), new


def merged_cards(existing: DataFrame, drafts: DataFrame, kept: list[str], taken: list[str]) -> DataFrame:
    """existing with the content of drafts(id, target_version, ...): kept columns stay, taken ones change, the version grows.

    `fault` tells of a draft whose target has another version than when it was compared.
    """
    told = existing.join(drafts.select("id", F.col("target_version"), *[F.col(c).alias(f"_{c}") for c in taken]), "id")
    fits = F.col("version") == F.col("target_version")
    return told.select("id", *kept, *[F.when(fits, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in taken], F.when(fits, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.when(~fits, "target_changed").alias("fault"))


def changed_fields(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after): fields that differ, nulls counted as values; after may lack rows and set fields to null to leave them."""
    told = before.join(after.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key)
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), F.col(f"_{c}").cast("string").alias("after")) for c in fields])
    return told.select(key, F.explode(rows).alias("r")).select(key, "r.*").filter(~F.col("before").eqNullSafe(F.col("after")) & F.col("after").isNotNull())


def edited_drafts(drafts: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """drafts(key, revision, manual) after changes: one revision more, the fields noted, to be reviewed again."""
    fields = changes.groupBy(key).agg(F.array_sort(F.collect_set("field")).alias("_f"))
    told = drafts.join(fields, key, "left")
    some = F.col("_f").isNotNull()
    manual = F.array_sort(F.array_distinct(F.concat("manual", F.coalesce("_f", F.array().cast("array<string>")))))
    return told.select(key, (F.col("revision") + F.when(some, 1).otherwise(0)).alias("revision"), F.when(some, "needs_review").otherwise(F.col("status")).alias("status"), F.when(some, manual).otherwise(F.col("manual")).alias("manual"))


def confirm_fault(d: DataFrame) -> Column:
    """Why a draft can't be confirmed; null where it can."""
    return (
        F.when(F.col("confirmed_revision") != F.col("revision"), "revision_changed").when(~F.col("selected") | (F.col("disposition") != "active") | F.col("undecided"), "target_changed")
        .when(~F.col("passed") | (F.col("status") != "ready") | (F.col("revision") != F.col("validated_revision")), "not_checked")
    )


def import_status(pages: DataFrame, job: str) -> DataFrame:
    """(job, parsed, failed, needs_ocr, status): partial where a selected page failed."""
    s = F.col("status")
    told = pages.groupBy(job).agg(F.count_if(s == "parsed").alias("parsed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "needs_ocr").alias("needs_ocr"), F.count_if((s == "failed") & F.col("selected")).alias("_p"))
    return told.select(job, "parsed", "failed", "needs_ocr", F.when(F.col("_p") > 0, "partial").otherwise("ready").alias("status"))


def selection_id(asset: Column, text: Column, ranges: Column, parser: Column) -> Column:
    """The id of a selection: a digest of what was taken from which asset by which parser."""
    return F.concat(F.lit("selection_"), F.sha2(F.to_json(F.struct(asset.alias("asset"), text.alias("text"), ranges.alias("ranges"), parser.alias("parser"))), 256))


# ---- findings, verdicts, evidence


def finding_faults(findings: DataFrame, fields: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, place, fault): findings of an unknown field, without quote or reason, whose quote isn't in the field, or too many.

    fields(key, field, value) holds the parts of a candidate, one row for each value of a list.
    """
    name = F.regexp_replace("field", r"\[(\d+)\]", r".$1")
    own = findings.withColumn("field", name).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    held = fields.select(key, "field", "value")
    hit = own.join(held, [key, "field"], "left").groupBy(key, "place", "field", "quote", "reason", "_n").agg(F.coalesce(F.bool_or(F.contains("value", F.col("quote"))), F.lit(False)).alias("_hit"))
    text = lambda c, n: (F.trim(F.coalesce(F.col(c), F.lit(""))) != "") & (F.length(c) <= n)
    fault = (
        F.when(F.col("_n") > most, "too_many").when(~F.rlike("field", F.lit(FIELDS)), "unknown_field").when(~text("quote", MAX_QUOTE) | ~text("reason", MAX_REASON), "incomplete").when(~F.col("_hit"), "quote_absent")
    )
    return hit.select(key, "place", fault.alias("fault")).filter("fault IS NOT NULL")


def option_verdicts(candidates: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """(key, code): verdicts(key, index, valid, misconception_ok, reason) that don't cover each option once, or disagree with the key."""
    good = (F.col("index") >= 0) & (F.col("index") < F.col("options")) & F.col("valid").isNotNull() & F.col("misconception_ok").isNotNull() & (F.trim(F.coalesce("reason", F.lit(""))) != "")
    told = candidates.select(key, "options", "correct_index").join(verdicts, key, "left")
    per = told.groupBy(key, "options").agg(
        F.count("index").alias("n"), F.count_distinct("index").alias("distinct"), F.coalesce(F.bool_and(F.coalesce(good, F.lit(False))), F.lit(False)).alias("good"),
        F.count_if(F.col("valid") != (F.col("index") == F.col("correct_index"))).alias("wrong"), F.count_if(~F.col("misconception_ok")).alias("bad"),
    )
    complete = (F.col("n") == F.col("options")) & (F.col("distinct") == F.col("options")) & F.col("good")
    codes = F.array_compact(F.array(F.when(~complete, "incomplete"), F.when(complete & (F.col("wrong") > 0), "disagrees"), F.when(complete & (F.col("bad") > 0), "misconception")))
    return per.select(key, F.explode(codes).alias("code"))


def recall_verdict(equivalent: Column, follows: Column, reason: Column) -> Column:
    missing = equivalent.isNull() | follows.isNull() | (F.trim(F.coalesce(reason, F.lit(""))) == "")
    return F.when(missing, "recall_comparison_invalid").when(~equivalent | ~follows, "independent_answer_mismatch")


def solution_fault(candidates: DataFrame, judgments: DataFrame, key: str) -> DataFrame:
    """(key, fault): the solver's judgments(key, index, option, valid) are unusable, or don't single out the key."""
    told = candidates.select(key, "options", "correct_index", "answerable").join(judgments, key, "left")
    fits = F.coalesce((F.get("options", F.col("index")) == F.col("option")) & F.col("valid").isNotNull(), F.lit(False))
    per = told.groupBy(key, "correct_index", "answerable", F.size("options").alias("n")).agg(F.count("index").alias("told"), F.count_distinct("index").alias("distinct"), F.bool_and(fits).alias("fits"), F.count_if("valid").alias("valid"), F.min(F.when(F.col("valid"), F.col("index"))).alias("first"))
    usable = F.col("fits") & (F.col("told") == F.col("n")) & (F.col("distinct") == F.col("n"))
    fault = F.when(~usable, "invalid").when(~F.col("answerable"), "unavailable").when((F.col("valid") != 1) | ~F.col("first").eqNullSafe(F.col("correct_index")), "mismatch")
    return per.select(key, fault.alias("fault")).filter("fault IS NOT NULL")


def expanded_evidence(supports: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, claim, ref, fault): the references of supports(key, supports map<claim, ids>), those without a single definition with a fault."""
    rows = supports.select(key, F.explode("supports").alias("claim", "ids")).select(key, "claim", F.posexplode("ids").alias("place", "ref"))
    defined = evidence.groupBy(key, "ref").agg(F.count("*").alias("n"))
    again = F.row_number().over(Window.partitionBy(key, "claim", "ref").orderBy("place")) > 1
    fault = F.when(~F.col("claim").isin(CLAIMS), "unknown_claim").when(F.col("n").isNull(), "unknown_reference").when(F.col("n") > 1, "redefined_reference").when(F.col("again"), "duplicate_reference")
    return rows.withColumn("again", again).join(defined, [key, "ref"], "left").select(key, "claim", "place", "ref", fault.alias("fault"))


def compacted_evidence(references: DataFrame, key: str, same: list[str]) -> DataFrame:
    """(key, claim, refs): distinct references numbered c1, c2, ... by first use, and the numbers that each claim uses in order."""
    first = references.groupBy(key, *same).agg(F.min("place").alias("first"))
    named = first.withColumn("ref", F.concat(F.lit("c"), F.row_number().over(Window.partitionBy(key).orderBy("first")).cast("string")))
    told = references.join(named, [key, *same])
    return told.groupBy(key, "claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ref"))), lambda x: x["ref"]).alias("refs"))


def positional_misconceptions(options: Column, given: Column, correct: Column) -> Column:
    """Misconceptions by option: a list that lacks the right option's gets an empty text in its place."""
    compact = F.size(given) == F.size(options) - 1
    return F.when(compact, F.concat(F.slice(given, F.lit(1), correct), F.array(F.lit("")), F.slice(given, correct + 1, F.size(given)))).otherwise(given)


def patched_evidence(before: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Evidence after a patch: claims that the patch speaks of are replaced as a whole, others stay."""
    replaced = patch.select(key, "claim").distinct()
    return before.join(replaced, [key, "claim"], "left_anti").unionByName(patch)


# ---- evaluation


def adoption(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """(key, failures, passed): metrics of a candidate strategy that regress, gain nothing at the top, are too slow or too large."""
    b, c = (lambda n: F.col(f"_{n}")), F.col
    told = candidate.join(baseline.select(key, *[F.col(m).alias(f"_{m}") for m in GATED]), key)
    missing = [F.when(c(m).isNull() | b(m).isNull(), F.lit(f"{m} missing")) for m in GATED]
    worse = [F.when(c(m) < b(m), F.lit(f"{m} regressed")) for m in GATED]
    still = F.when((c("hit_at_1") <= b("hit_at_1")) & (c("mrr_at_3") <= b("mrr_at_3")), F.lit("no top-rank improvement"))
    slow = F.when(F.coalesce(c("p95_ms") > MAX_P95_MS, F.lit(True)), F.lit("too slow"))
    large = F.when(c("bytes") > MAX_BYTES, F.lit("too large"))
    return told.select(key, F.array_compact(F.array(*missing, *worse, still, slow, large)).alias("failures")).withColumn("passed", F.size("failures") == 0)


def label_faults(labels: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, fault): labels(query_id, split, doc_id, needle) of another split or whose text no chunk of the document holds."""
    told = labels.join(documents.select("doc_id", F.col("split").alias("_s")), "doc_id", "left")
    held = labels.join(chunks, "doc_id").filter(F.contains("text", F.col("needle"))).select("query_id", "doc_id", "needle").distinct().withColumn("_h", F.lit(True))
    told = told.join(held, ["query_id", "doc_id", "needle"], "left")
    fault = F.when(F.coalesce("needle", F.lit("")) == "", "empty").when(~F.col("split").eqNullSafe(F.col("_s")), "cross_split").when(F.col("_h").isNull(), "not_found")
    return told.select("query_id", "doc_id", fault.alias("fault")).filter("fault IS NOT NULL")


def blind_ratings(ratings: DataFrame, mapping: DataFrame) -> DataFrame:
    """ratings(label, score) with the version that the label stood for and a fault: unknown label, repeated, or no whole score from 1 to 5."""
    known = mapping.groupBy("label").agg(F.min("version").alias("version"))
    told = ratings.withColumn("_n", F.count("*").over(Window.partitionBy("label"))).join(known, "label", "left")
    fault = F.when(F.col("version").isNull(), "unknown_label").when(F.col("_n") > 1, "repeated").when(F.col("score").isNull() | ~F.col("score").between(1, 5) | (F.col("score") != F.floor("score")), "invalid_score")
    return told.select("label", "version", "score", fault.alias("fault"))


def flagged(fields: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(key, field, code) of an exploded table of fields whose text matches the pattern of a rule."""
    codes = F.array_compact(F.array(*[F.when(F.rlike("value", F.lit(p)), F.lit(code)) for code, p in rules.items()]))
    return fields.select("key", "field", F.explode(codes).alias("code"))


def any_of(words: list[str]) -> str:
    return reduce(lambda a, b: f"{a}|{b}", words)
