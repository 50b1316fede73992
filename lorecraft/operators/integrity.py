"""Tables that refer to each other: sources, payloads, plans and their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versioned_update(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, version, change): the version rises only where the content differs."""
    both = old.select(key, F.col(content).alias("_o"), "version").join(new.select(key, F.col(content).alias("_n"), F.lit(True).alias("_in")), key, "full")
    change = F.when(F.col("version").isNull(), "inserted").when(F.col("_in").isNull(), "kept").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("updated")
    return both.select(key, (F.coalesce("version", F.lit(0)) + change.isin("inserted", "updated").cast("int")).alias("version"), change.alias("change"))


def payload_split(rows: DataFrame, key: str, large: list[str]) -> tuple[DataFrame, DataFrame]:
    """(index, payloads): large columns by their digest, which equal contents share."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in large]), 256)
    told = rows.withColumn("payload_id", digest)
    return told.drop(*large), told.groupBy("payload_id").agg(*[F.any_value(c).alias(c) for c in large])


def hydrated(index: DataFrame, payloads: DataFrame) -> DataFrame:
    """index with its payloads; a row whose payload is missing fails the job."""
    told = index.join(payloads.withColumn("_found", F.lit(True)), "payload_id", "left")
    return told.filter(F.coalesce(F.col("_found"), F.raise_error(F.lit("a payload is missing")).cast("boolean"))).drop("_found")


def orphans(stored: DataFrame, key: str, references: list[DataFrame]) -> DataFrame:
    """Rows of stored that none of the references(key) names."""
    named = references[0]
    for other in references[1:]:
        named = named.unionByName(other)
    return stored.join(named.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def source_status(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_id, status, retention): a kept source without its document is removed."""
    there = documents.select("document_id", F.lit(True).alias("there"), "original")
    told = sources.join(there, "document_id", "left")
    status = F.when(F.col("there"), "available").when(F.col("retention") == "excerpt", "excerpt_only").otherwise("removed")
    kept = F.when(F.col("retention") == "excerpt", "excerpt").when(F.coalesce("original", F.lit(False)), "original").otherwise("full_text")
    return told.select("source_id", status.alias("status"), kept.alias("retention"))


def missing_sources(documents: DataFrame, sources: DataFrame) -> DataFrame:
    return documents.join(sources.select("document_id"), "document_id", "left_anti").select(F.concat(F.lit("source_"), F.col("document_id").cast("string")).alias("source_id"), "document_id")


def unreferenced_after_delete(cards: DataFrame, deleted: DataFrame) -> DataFrame:
    """(source_id): sources of deleted cards that no other card names. cards(card_id, source_id)."""
    gone = cards.join(deleted.select("card_id"), "card_id", "left_semi").select("source_id").distinct()
    left = cards.join(deleted.select("card_id"), "card_id", "left_anti").select("source_id").distinct()
    return gone.join(left, "source_id", "left_anti")


def null_filled(rows: DataFrame, dimension: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rows with the null fields taken from the dimension."""
    d = dimension.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    told = rows.join(d, key, "left")
    return told.withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).drop(*[f"_{c}" for c in fields])


def relations(edges: DataFrame, types: list[str]) -> DataFrame:
    """Distinct (plan, source, target, type) of known types without self loops."""
    return edges.filter(F.col("type").isin(types) & (F.col("source") != F.col("target"))).select("plan", "source", "target", "type").distinct()


def rewritten(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after units were merged or split: both ends by mapping(old, new), others as they are, no self loops, no repeats."""
    by = lambda side: mapping.select(F.col("old").alias(side), F.col("new").alias(f"_{side}"))
    told = edges.join(by("source"), "source", "left").join(by("target"), "target", "left")
    told = told.select("plan", F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target"), "type")
    return told.filter("source <> target").distinct()


def neighbourhood(edges: DataFrame, most: int) -> DataFrame:
    """(plan, unit, other, type): relations of each unit in both directions, at most so many."""
    both = edges.select("plan", F.col("source").alias("unit"), F.col("target").alias("other"), "type").unionByName(edges.select("plan", F.col("target").alias("unit"), F.col("source").alias("other"), "type"))
    place = F.row_number().over(Window.partitionBy("plan", "unit").orderBy("other", "type"))
    return both.withColumn("place", place).filter(F.col("place") <= most)


def plan_status(parts: DataFrame) -> DataFrame:
    """(plan, status): ready when all parts completed, needs_attention when one failed, else paused."""
    done, bad = F.bool_and(F.col("status") == "completed"), F.bool_or(F.col("status") == "failed")
    return parts.groupBy("plan").agg(F.when(done, "ready").when(bad, "needs_attention").otherwise("paused").alias("status"), F.count("*").alias("parts"))


def coverage_violations(chunks: DataFrame, coverage: DataFrame) -> DataFrame:
    """(plan, chunk, fault): chunks without or with several rows of coverage(plan, chunk, unit, reason), and rows without a chunk or a reason."""
    counts = coverage.groupBy("plan", "chunk").agg(F.count("*").alias("n"), F.bool_or(F.col("unit").isNull() & F.col("reason").isNull()).alias("unexplained"))
    told = chunks.select("plan", "chunk", F.lit(True).alias("known")).join(counts, ["plan", "chunk"], "full")
    fault = F.when(F.col("known").isNull(), "unknown_chunk").when(F.col("n").isNull(), "uncovered").when(F.col("n") > 1, "covered_twice").when(F.col("unexplained"), "no_reason")
    return told.select("plan", "chunk", fault.alias("fault")).filter("fault IS NOT NULL")


def merged_units(units: DataFrame, objective: Column) -> DataFrame:
    """(plan, objective, unit, evidence): units whose objectives are equal without space and punctuation, with all their evidence."""
    key = F.regexp_replace(F.lower(objective), r"[\s\p{P}]+", "")
    return units.groupBy("plan", key.alias("objective")).agg(F.min("unit").alias("unit"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"))
