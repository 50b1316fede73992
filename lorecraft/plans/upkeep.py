"""Queries of upkeep, findings, verdicts and evaluation gates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import quality as Q
from lorecraft.operators import retrieval as R
from lorecraft.operators import scalars as V
from lorecraft.operators import upkeep as U
from lorecraft.plans.quality import _C, candidates
from lorecraft.plans.registry import Registry
from lorecraft.plans.scalars import pick

query = Registry()
_RV = B.RV_SQL
rv = B.review_events


def s(c):
    return c.cast("string")


@query("M5_card_defaults", _RV + "SELECT id, CASE WHEN exercise % 3 = 0 THEN 'unit_' || id ELSE 'u' || unit END AS unit, CASE WHEN exercise % 4 = 0 THEN 'new' WHEN unit > 5 THEN 'review' ELSE 'scheduled' END AS stage, CASE WHEN exercise % 2 = 0 THEN 'v2' ELSE 'legacy-card-schedule' END AS schedule_version, CASE WHEN exercise % 5 = 0 THEN exercise ELSE 1 END AS version FROM rv")
def m5(spark, d):
    k = F.col("exercise")
    c = rv(spark, d).select("id", F.when(k % 3 != 0, F.concat(F.lit("u"), s(F.col("unit")))).alias("unit"), F.when(k % 4 == 0, "new").alias("stage"), F.when(F.col("unit") > 5, 2).alias("review_count"), F.when(k % 2 == 0, "v2").alias("schedule_version"), F.when(k % 5 == 0, k).alias("version"))
    return U.card_defaults(c)


@query("M1_backfill", _RV + "SELECT learner, count(*) AS rows, greatest(1, least(20, coalesce(CASE WHEN learner % 3 <> 0 THEN learner % 40 END, 3)))::BIGINT AS daily_goal, max(CASE WHEN learner % 4 = 0 THEN 1 ELSE learner % 7 + 1 END)::INT AS memory_version FROM rv GROUP BY learner")
def m1(spark, d):
    own = rv(spark, d).groupBy("learner").agg(F.count("*").alias("rows"))
    goal, version = F.when(F.col("learner") % 3 != 0, F.col("learner") % 40), F.when(F.col("learner") % 4 != 0, F.col("learner") % 7 + 1)
    return own.select("learner", "rows", V.bounded_integer(goal, 1, 20, 3).alias("daily_goal"), F.coalesce(version, F.lit(1)).cast("int").alias("memory_version"))


@query("M2_units_upsert", _RV + """, t AS (SELECT exercise AS unit, arg_max('t' || learner, ms) AS topic, arg_max('o' || id, ms) AS objective FROM rv WHERE event_type = 'purchase' GROUP BY exercise), u AS (SELECT DISTINCT exercise AS unit FROM rv WHERE exercise % 2 = 0)
SELECT coalesce(u.unit, t.unit) AS unit, coalesce(t.topic, 'old') AS topic, coalesce(t.objective, 'old') AS objective FROM u FULL JOIN t ON u.unit = t.unit""")
def m2(spark, d):
    own = rv(spark, d)
    units = own.filter("exercise % 2 = 0").select(F.col("exercise").alias("unit"), F.lit("old").alias("topic"), F.lit("old").alias("objective")).distinct()
    targets = own.filter("event_type = 'purchase'").select(F.col("exercise").alias("unit"), F.concat(F.lit("t"), s(F.col("learner"))).alias("topic"), F.concat(F.lit("o"), s(F.col("id"))).alias("objective"), "ms")
    return U.upserted_units(units, targets)


@query("M8_card_sources", _RV + "SELECT DISTINCT id, source FROM (SELECT id, 's' || unit AS source FROM rv UNION ALL SELECT id, 's' || exercise % 7 FROM rv WHERE exercise % 3 <> 0 UNION ALL SELECT id, 's' || learner % 9 FROM rv)")
def m8(spark, d):
    name = lambda c: F.concat(F.lit("s"), s(c))
    return U.source_ids(rv(spark, d).select("id", F.array(name(F.col("unit"))).alias("sources"), F.when(F.col("exercise") % 3 != 0, name(F.col("exercise") % 7)).alias("snapshot"), F.array(name(F.col("learner") % 9)).alias("cited")))


@query("M10_attempt_status", _RV + "SELECT event_type, CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'answered' ELSE 'abandoned' END AS status, count(*) AS n FROM rv GROUP BY 1, 2")
def m10(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "active").when(kind == "click", "answered").when(kind == "error", "broken")
    return rv(spark, d).groupBy("event_type", U.attempt_status(status).alias("status")).agg(F.count("*").alias("n"))


@query("M11_preference_scope", _RV + "SELECT id, exercise % 4 <> 0 AS enabled, greatest(1, exercise % 3) AS version, CASE WHEN exercise % 5 IN (1, 2) THEN 'global' ELSE 'topic' END AS scope_type FROM rv WHERE event_type = 'signup'")
def m11(spark, d):
    k = F.col("exercise")
    category = pick(k, "topic_interest", "learning_format", "custom", "topic_downrank", "difficulty_preference")
    return rv(spark, d).filter("event_type = 'signup'").select("id", F.coalesce(F.when(k % 4 == 0, F.lit(False)), F.lit(True)).alias("enabled"), F.greatest(F.lit(1), k % 3).alias("version"), F.when(category.isin("learning_format", "custom"), "global").otherwise("topic").alias("scope_type"))


@query("M13_removed_source", """SELECT (SELECT count(*) FROM documents WHERE doc_id % 6 <> 0) AS documents, (SELECT count(*) FROM documents WHERE doc_id % 6 = 0) AS removed, (SELECT count(*) FROM documents WHERE NOT (doc_id % 6 = 0 AND doc_id % 4 = 0)) AS texts""")
def m13(spark, d):
    docs = B.documents(spark, d).select("doc_id", "text")
    d2, s2, m2_ = U.removed_source(docs, docs.select("doc_id", F.lit("available").alias("status")), docs.withColumn("completed", F.col("doc_id") % 4 == 0), docs.filter("doc_id % 6 = 0"))
    one = lambda t, c, n: t.agg(c.alias(n))
    a, b, c = one(d2, F.count("*"), "documents"), one(s2, F.count_if(F.col("status") == "removed"), "removed"), one(m2_, F.count("text"), "texts")
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


@query("M15_detached_source", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS source, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS citations FROM documents")
def m15(spark, d):
    """Cards without what they said of their source; nothing else of them changes."""
    gone = F.col("doc_id") % 5 == 0
    return B.documents(spark, d).select("doc_id", F.when(gone, "").otherwise(F.col("source")).alias("source"), F.when(gone, 0).otherwise(1).alias("citations"))


@query("M16_promoted", _RV + "SELECT count(*) AS cards, count(*) FILTER (WHERE id NOT IN (SELECT id FROM rv WHERE event_type = 'view')) AS draws FROM (SELECT id FROM rv WHERE event_type = 'view' UNION SELECT id FROM rv WHERE exercise % 3 = 0)")
def m16(spark, d):
    own = rv(spark, d).select("id", "event_type", "exercise")
    pending = own.filter("exercise % 3 = 0").select("id", "exercise")
    library, new = U.promoted(pending, own.filter("event_type = 'view'").select("id", "exercise"), pending.select("id").unionByName(pending.select("id")))
    return library.agg(F.count("*").alias("cards")).crossJoin(F.broadcast(new.agg(F.count("*").alias("draws"))))  # one row each


_MERGE = "WITH e AS (SELECT item_id AS id, substr(text, 1, 20) AS title, text AS summary, item_id % 2 = 0 AS favourite, (item_id % 3 + 1)::INT AS version FROM benchmark), m AS (SELECT *, CASE WHEN id % 4 = 0 THEN version + 1 ELSE version END AS tv FROM e WHERE id % 5 <> 0)\n"


def _merge(spark, d):
    i = F.col("item_id")
    e = B.table(spark, d, "benchmark").select(i.alias("id"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("summary"), (i % 2 == 0).alias("favourite"), (i % 3 + 1).cast("int").alias("version"))
    drafts = e.filter("id % 5 <> 0").select("id", F.when(F.col("id") % 4 == 0, F.col("version") + 1).otherwise(F.col("version")).alias("target_version"), F.when(F.col("id") % 3 == 0, F.col("title")).otherwise(F.concat(F.lit("new "), F.col("title"))).alias("title"), F.concat("summary", F.lit("!")).alias("summary"))
    return e, drafts


@query("M17_merged_cards", _MERGE + "SELECT id, favourite, CASE WHEN tv = version AND id % 3 <> 0 THEN 'new ' || title ELSE title END AS title, CASE WHEN tv = version THEN summary || '!' ELSE summary END AS summary, CASE WHEN tv = version THEN version + 1 ELSE version END AS version, CASE WHEN tv <> version THEN 'target_changed' END AS fault FROM m")
def m17(spark, d):
    return U.merged_cards(*_merge(spark, d), ["favourite"], ["title", "summary"])


@query("M18_merge_preview", _MERGE + "SELECT id, 'title' AS field, title AS before, 'new ' || title AS after FROM m WHERE id % 3 <> 0 UNION ALL SELECT id, 'summary', summary, summary || '!' FROM m")
def m18(spark, d):
    return U.changed_fields(*_merge(spark, d), "id", ["title", "summary"])


@query("M23_draft_edits", _MERGE + "SELECT id, version + CASE WHEN id % 5 <> 0 THEN 1 ELSE 0 END AS revision, CASE WHEN id % 5 <> 0 THEN 'needs_review' ELSE 'ready' END AS status, CASE WHEN id % 5 = 0 THEN 'title' ELSE 'summary,title' END AS manual FROM e")
def m23(spark, d):
    e, drafts = _merge(spark, d)
    changes = U.changed_fields(e, drafts, "id", ["title", "summary"])
    own = e.select("id", F.col("version").alias("revision"), F.lit("ready").alias("status"), F.array(F.lit("title")).alias("manual"))
    return U.edited_drafts(own, changes, "id").withColumn("manual", F.array_join("manual", ","))


@query("M19_confirm_gate", _RV + "SELECT id, CASE WHEN exercise % 7 = 0 THEN 'revision_changed' WHEN exercise % 3 = 0 OR unit = 4 THEN 'target_changed' WHEN NOT correct OR exercise % 5 = 0 THEN 'not_checked' END AS fault FROM rv")
def m19(spark, d):
    k = F.col("exercise")
    own = rv(spark, d).select("id", F.lit(2).alias("revision"), F.when(k % 7 == 0, 1).otherwise(2).alias("confirmed_revision"), (k % 3 != 0).alias("selected"), F.lit("active").alias("disposition"), (F.col("unit") == 4).alias("undecided"), F.col("correct").alias("passed"), F.lit("ready").alias("status"), F.when(k % 5 == 0, 1).otherwise(2).alias("validated_revision"))
    return own.select("id", U.confirm_fault(own).alias("fault"))


@query("M20_import_state", "SELECT source, count(*) FILTER (WHERE doc_id % 5 > 1) AS parsed, count(*) FILTER (WHERE doc_id % 5 = 0) AS failed, count(*) FILTER (WHERE doc_id % 5 = 1) AS needs_ocr, CASE WHEN count(*) FILTER (WHERE doc_id % 5 = 0 AND doc_id % 3 = 0) > 0 THEN 'partial' ELSE 'ready' END AS status FROM documents GROUP BY source")
def m20(spark, d):
    i = F.col("doc_id")
    return U.import_status(B.documents(spark, d).select("source", F.when(i % 5 == 0, "failed").when(i % 5 == 1, "needs_ocr").otherwise("parsed").alias("status"), (i % 3 == 0).alias("selected")), "source")


@query("M21_selection_ids", """SELECT doc_id, 'selection_' || sha256('{"asset":"a' || doc_id || '","text":"t' || doc_id % 9 || '","ranges":"0-' || n_chars || '","parser":"p1"}') AS id FROM documents""")
def m21(spark, d):
    i = F.col("doc_id")
    return B.documents(spark, d).select("doc_id", U.selection_id(F.concat(F.lit("a"), s(i)), F.concat(F.lit("t"), s(i % 9)), F.concat(F.lit("0-"), s(F.col("n_chars"))), F.lit("p1")).alias("id"))


@query("M6_legacy_exercises", _C + "SELECT 'exercise_legacy_' || id AS exercise, id, options[correct_index + 1] AS answer FROM c WHERE trim(question) <> '' AND correct_index < len(options)")
def m6(spark, d):
    """Exercise rows of the questions that cards carry themselves, only where the key names an option."""
    answer = F.get("options", F.col("correct_index"))
    return candidates(spark, d).filter(Q.present("question") & answer.isNotNull()).select(F.concat(F.lit("exercise_legacy_"), s(F.col("id"))).alias("exercise"), "id", answer.alias("answer"))


@query("M7_snapshot_status", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'removed' WHEN doc_id % 4 = 0 THEN 'outdated' ELSE 'available' END AS status FROM documents")
def m7(spark, d):
    """Status of a card's snapshot by the source as it is now."""
    docs, i = B.documents(spark, d).select("doc_id"), F.col("doc_id")
    live = docs.filter("doc_id % 6 <> 0").select("doc_id", F.when(i % 4 == 0, 2).otherwise(1).alias("version"))
    told = docs.withColumn("seen", F.lit(1)).join(live, "doc_id", "left")
    return told.select("doc_id", F.when(F.col("version").isNull(), "removed").when(F.col("version") != F.col("seen"), "outdated").otherwise("available").alias("status"))


# ---- findings and verdicts


@query("QA3_generic", _C + "SELECT id, field FROM (SELECT id, 'summary' AS field, summary AS v FROM c UNION ALL SELECT id, 'question', question FROM c UNION ALL SELECT id, 'options', array_to_string(options, ' ') FROM c) WHERE v IN ('先收藏以后再说', '最该先抓什么') OR contains(v, '以后再说')")
def qa3(spark, d):
    c = candidates(spark, d)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("v")) for f, v in (("summary", F.col("summary")), ("question", F.col("question")), ("options", F.array_join("options", " ")))])
    return c.select("id", F.explode(rows).alias("r")).select("id", "r.*").filter(Q.generic("v")).select("id", "field")


@query("QA22_option_verdicts", """WITH c AS (SELECT item_id AS id, item_id % 3 AS ci, 3 + item_id % 2 AS n FROM benchmark), v AS (SELECT id, ci, n, i AS index, CASE WHEN id % 7 = 0 THEN i = 0 ELSE i = ci END AS valid, NOT (id % 5 = 0 AND i = 1) AS ok, CASE WHEN id % 11 = 0 THEN '' ELSE 'r' END AS reason FROM c, range(0, 4) r(i) WHERE i < n AND NOT (id % 9 = 0 AND i = 2)),
p AS (SELECT id, n, count(*) AS k, bool_and(reason <> '') AS good, count(*) FILTER (WHERE valid <> (index = ci)) AS wrong, count(*) FILTER (WHERE NOT ok) AS bad FROM v GROUP BY id, n)
SELECT id, 'incomplete' AS code FROM p WHERE k <> n OR NOT good UNION ALL SELECT id, 'disagrees' FROM p WHERE k = n AND good AND wrong > 0 UNION ALL SELECT id, 'misconception' FROM p WHERE k = n AND good AND bad > 0""")
def qa22(spark, d):
    i = F.col("item_id")
    c = B.table(spark, d, "benchmark").select(i.alias("id"), (i % 3).cast("int").alias("correct_index"), (3 + i % 2).cast("int").alias("options"))
    v = c.select("id", "correct_index", F.explode(F.sequence(F.lit(0), F.col("options") - 1)).alias("index")).filter("NOT (id % 9 = 0 AND index = 2)")
    v = v.select("id", "index", F.when(F.col("id") % 7 == 0, F.col("index") == 0).otherwise(F.col("index") == F.col("correct_index")).alias("valid"), (~((F.col("id") % 5 == 0) & (F.col("index") == 1))).alias("misconception_ok"), F.when(F.col("id") % 11 == 0, "").otherwise("r").alias("reason"))
    return U.option_verdicts(c, v, "id")


@query("QA23_recall_verdicts", "SELECT item_id, CASE WHEN item_id % 4 = 0 OR item_id % 7 = 0 THEN 'recall_comparison_invalid' WHEN item_id % 3 = 0 OR item_id % 5 = 0 THEN 'independent_answer_mismatch' END AS issue FROM benchmark")
def qa23(spark, d):
    i = F.col("item_id")
    return B.table(spark, d, "benchmark").select("item_id", U.recall_verdict(F.when(i % 4 != 0, i % 3 != 0), i % 5 != 0, F.when(i % 7 == 0, " ").otherwise("same")).alias("issue"))


@query("QA25_finding_faults", """WITH f AS (SELECT item_id AS id, i AS place, ['card.summary', 'card.title', 'card.colour', 'exercise.options[1]'][(i + item_id) % 4 + 1] AS field, CASE i WHEN 0 THEN substr(text, 5, 10) WHEN 1 THEN 'never said so' ELSE substr(text, 1, 3) END AS quote, CASE WHEN item_id % 6 = 0 THEN '' ELSE 'r' END AS reason, text FROM benchmark, range(0, 10) r(i) WHERE i < 3 OR item_id % 13 = 0),
g AS (SELECT *, replace(replace(field, '[', '.'), ']', '') AS fd, count(*) OVER (PARTITION BY id) AS n FROM f)
SELECT id, place, fault FROM (SELECT id, place, CASE WHEN n > 8 THEN 'too_many' WHEN fd = 'card.colour' THEN 'unknown_field' WHEN trim(quote) = '' OR reason = '' THEN 'incomplete' WHEN NOT CASE fd WHEN 'card.summary' THEN contains(text, quote) WHEN 'card.title' THEN contains(substr(text, 1, 8), quote) ELSE contains(substr(text, 1, 4), quote) END THEN 'quote_absent' END AS fault FROM g) WHERE fault IS NOT NULL""")
def qa25(spark, d):
    i = F.col("item_id")
    b = B.table(spark, d, "benchmark")
    f = b.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(9)))).filter("place < 3 OR item_id % 13 = 0")
    f = f.select(i.alias("id"), "place", pick(F.col("place") + i, "card.summary", "card.title", "card.colour", "exercise.options[1]").alias("field"), F.when(F.col("place") == 0, F.substring("text", 5, 10)).when(F.col("place") == 1, "never said so").otherwise(F.substring("text", 1, 3)).alias("quote"), F.when(i % 6 == 0, "").otherwise("r").alias("reason"))
    parts = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in (("card.summary", F.col("text")), ("card.title", F.substring("text", 1, 8)), ("exercise.options.1", F.substring("text", 1, 4)))])
    return U.finding_faults(f, b.select(i.alias("id"), F.explode(parts).alias("p")).select("id", "p.*"), "id")


@query("QA26_evidence_links", """WITH r AS (SELECT item_id AS id, claim, p AS place, 'c' || (item_id + p * (2 + item_id % 2)) % 4 AS ref FROM benchmark, (VALUES ('summary'), ('exercise'), ('colour')) c(claim), range(0, 3) r(p)), e AS (SELECT item_id AS id, 'c' || i AS ref FROM benchmark, range(0, 3) r(i) UNION ALL SELECT item_id, 'c1' FROM benchmark WHERE item_id % 5 = 0),
n AS (SELECT id, ref, count(*) AS n FROM e GROUP BY ALL)
SELECT r.id, claim, place, r.ref, CASE WHEN claim = 'colour' THEN 'unknown_claim' WHEN n IS NULL THEN 'unknown_reference' WHEN n > 1 THEN 'redefined_reference' WHEN row_number() OVER (PARTITION BY r.id, claim, r.ref ORDER BY place) > 1 THEN 'duplicate_reference' END AS fault FROM r LEFT JOIN n ON n.id = r.id AND n.ref = r.ref""")
def qa26(spark, d):
    i = F.col("item_id")
    b = B.table(spark, d, "benchmark")
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda p: F.concat(F.lit("c"), s((i + p * (2 + i % 2)) % 4)))
    supports = b.select(i.alias("id"), F.create_map(F.lit("summary"), ids, F.lit("exercise"), ids, F.lit("colour"), ids).alias("supports"))
    own = b.select(i.alias("id"), F.explode(F.array(F.lit("c0"), F.lit("c1"), F.lit("c2"))).alias("ref"))
    return U.expanded_evidence(supports, own.unionByName(b.filter("item_id % 5 = 0").select(i.alias("id"), F.lit("c1").alias("ref"))), "id")


@query("QA27_evidence_compact", """WITH r AS (SELECT conv_id, turn AS place, role AS claim, length(text) % 4 AS quote FROM conversations), f AS (SELECT conv_id, quote, 'c' || row_number() OVER (PARTITION BY conv_id ORDER BY min(place)) AS ref FROM r GROUP BY conv_id, quote)
SELECT r.conv_id, claim, string_agg(ref, ',' ORDER BY place) AS refs FROM r JOIN f ON f.conv_id = r.conv_id AND f.quote = r.quote GROUP BY ALL""")
def qa27(spark, d):
    r = B.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("place"), F.col("role").alias("claim"), (F.length("text") % 4).alias("quote"))
    return U.compacted_evidence(r, "conv_id", ["quote"]).withColumn("refs", F.array_join("refs", ","))


@query("QA28_misconceptions", "SELECT item_id, array_to_string(CASE item_id % 3 WHEN 0 THEN ['', 'm1', 'm2'] WHEN 1 THEN ['m1', '', 'm2'] ELSE ['m1', 'm2', ''] END, '|') AS misconceptions FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'm1|m2|m3' FROM benchmark WHERE item_id % 2 = 1")
def qa28(spark, d):
    i = F.col("item_id")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    given = F.when(i % 2 == 0, words("m1", "m2")).otherwise(words("m1", "m2", "m3"))
    return B.table(spark, d, "benchmark").select("item_id", F.array_join(U.positional_misconceptions(words("a", "b", "c"), given, (i % 3).cast("int")), "|").alias("misconceptions"))


@query("QA29_patched_evidence", _RV + "SELECT learner, claim, count(*) AS n, max(id) AS latest FROM (SELECT learner, event_type AS claim, id FROM rv WHERE exercise % 2 = 0 AND NOT EXISTS (SELECT 1 FROM rv p WHERE p.exercise % 2 = 1 AND p.unit = 3 AND p.learner = rv.learner AND p.event_type = rv.event_type) UNION ALL SELECT learner, event_type, id FROM rv WHERE exercise % 2 = 1 AND unit = 3) GROUP BY ALL")
def qa29(spark, d):
    own = rv(spark, d).select("learner", F.col("event_type").alias("claim"), "id", "exercise", "unit")
    cols = ["learner", "claim", "id"]
    return U.patched_evidence(own.filter("exercise % 2 = 0").select(*cols), own.filter("exercise % 2 = 1 AND unit = 3").select(*cols), "learner").groupBy("learner", "claim").agg(F.count("*").alias("n"), F.max("id").alias("latest"))


@query("QA30_independent_solution", """WITH c AS (SELECT item_id AS id, item_id % 3 AS ci, item_id % 8 <> 0 AS answerable FROM benchmark), j AS (SELECT id, ci, answerable, i AS index, CASE WHEN id % 10 = 0 AND i = 1 THEN 'x' ELSE ['a', 'b', 'c'][i + 1] END = ['a', 'b', 'c'][i + 1] AS fits, CASE WHEN id % 4 = 0 THEN i < 2 ELSE i = (ci + (id % 6) // 5) % 3 END AS valid FROM c, range(0, 3) r(i)),
p AS (SELECT id, ci, answerable, bool_and(fits) AS fits, count(*) FILTER (WHERE valid) AS v, min(index) FILTER (WHERE valid) AS f FROM j GROUP BY ALL)
SELECT id, fault FROM (SELECT id, CASE WHEN NOT fits THEN 'invalid' WHEN NOT answerable THEN 'unavailable' WHEN v <> 1 OR f <> ci THEN 'mismatch' END AS fault FROM p) WHERE fault IS NOT NULL""")
def qa30(spark, d):
    i = F.col("item_id")
    abc = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    c = B.table(spark, d, "benchmark").select(i.alias("id"), abc.alias("options"), (i % 3).cast("int").alias("correct_index"), (i % 8 != 0).alias("answerable"))
    j = c.withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(2))))
    key = F.pmod(F.col("correct_index") + F.floor(F.col("id") % 6 / 5), F.lit(3))
    j = j.select("id", "index", F.when((F.col("id") % 10 == 0) & (F.col("index") == 1), "x").otherwise(F.get("options", F.col("index"))).alias("option"), F.when(F.col("id") % 4 == 0, F.col("index") < 2).otherwise(F.col("index") == key).alias("valid"))
    return U.solution_fault(c, j, "id")


# ---- evaluation


_GATE = """WITH m AS (SELECT exercise % 20 AS run, avg(correct::INT) AS hit_at_1, avg((unit > 4)::INT) AS recall_at_3, avg((exercise % 3 = 0)::INT) AS mrr_at_3, avg(hint_used::INT) AS no_hit_accuracy, max(duration) AS p95_ms FROM rv GROUP BY 1), b AS (SELECT run - 1 AS run, hit_at_1 AS h, recall_at_3 AS r, mrr_at_3 AS q, no_hit_accuracy AS z FROM m)
SELECT run, array_to_string(list_filter([CASE WHEN hit_at_1 < h THEN 'hit_at_1 regressed' END, CASE WHEN recall_at_3 < r THEN 'recall_at_3 regressed' END, CASE WHEN mrr_at_3 < q THEN 'mrr_at_3 regressed' END, CASE WHEN no_hit_accuracy < z THEN 'no_hit_accuracy regressed' END, CASE WHEN hit_at_1 <= h AND mrr_at_3 <= q THEN 'no top-rank improvement' END, CASE WHEN p95_ms > 200 THEN 'too slow' END, CASE WHEN run % 5 = 0 THEN 'too large' END], lambda x: x IS NOT NULL), ';') AS failures FROM m JOIN b USING (run)"""


@query("EV3_adoption_gate", _RV + ", " + _GATE.removeprefix("WITH "))
def ev3(spark, d):
    one = lambda c, n: F.avg(c.cast("int")).alias(n)
    m = rv(spark, d).groupBy((F.col("exercise") % 20).alias("run")).agg(one(F.col("correct"), "hit_at_1"), one(F.col("unit") > 4, "recall_at_3"), one(F.col("exercise") % 3 == 0, "mrr_at_3"), one(F.col("hint_used"), "no_hit_accuracy"), F.max("duration").alias("p95_ms"))
    m = m.withColumn("bytes", F.when(F.col("run") % 5 == 0, 60_000_000).otherwise(0))
    return U.adoption(m.withColumn("run", F.col("run") - 1), m, "run").select("run", F.array_join("failures", ";").alias("failures"))


@query("EV4_label_faults", """WITH l AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 4 = 0 THEN 'dev' ELSE 'test' END AS split, doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'never said so ' || doc_id ELSE substr(text, 20, 30) END AS needle, text FROM documents)
SELECT query_id, doc_id, fault FROM (SELECT query_id, doc_id, CASE WHEN needle = '' THEN 'empty' WHEN split <> CASE WHEN doc_id % 8 = 0 THEN 'dev' ELSE 'test' END THEN 'cross_split' WHEN NOT contains(text, needle) THEN 'not_found' END AS fault FROM l) WHERE fault IS NOT NULL""")
def ev4(spark, d):
    docs, i = B.documents(spark, d), F.col("doc_id")
    labels = docs.select(i.alias("query_id"), F.when(i % 4 == 0, "dev").otherwise("test").alias("split"), "doc_id", F.when(i % 5 == 0, "").when(i % 5 == 1, F.concat(F.lit("never said so "), s(i))).otherwise(F.substring("text", 20, 30)).alias("needle"))
    return U.label_faults(labels, docs.select("doc_id", "text"), docs.select("doc_id", F.when(i % 8 == 0, "dev").otherwise("test").alias("split")))


@query("EV10_blind_ratings", _RV + """, r AS (SELECT 'l' || exercise AS label, CASE WHEN exercise % 6 = 0 THEN 2.5 ELSE unit::DOUBLE END AS score, count(*) OVER (PARTITION BY exercise) AS n FROM rv WHERE event_type = 'error' AND learner % 2 = 0)
SELECT label, CASE WHEN substr(label, 2)::INT % 5 <> 0 THEN CASE WHEN substr(label, 2)::INT % 2 = 0 THEN 'current' ELSE 'old' END END AS version, score, CASE WHEN substr(label, 2)::INT % 5 = 0 THEN 'unknown_label' WHEN n > 1 THEN 'repeated' WHEN score < 1 OR score > 5 OR score <> floor(score) THEN 'invalid_score' END AS fault FROM r""")
def ev10(spark, d):
    k = F.col("exercise")
    label = F.concat(F.lit("l"), s(k)).alias("label")
    ratings = rv(spark, d).filter("event_type = 'error' AND learner % 2 = 0").select(label, F.when(k % 6 == 0, F.lit(2.5)).otherwise(F.col("unit").cast("double")).alias("score"))
    mapping = rv(spark, d).filter(k % 5 != 0).select(label, F.when(k % 2 == 0, "current").otherwise("old").alias("version")).distinct()
    return U.blind_ratings(ratings, mapping)


@query("EV13_citation_audit", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'moved' ELSE 'same' END AS audit FROM documents WHERE length(text) > 60")
def ev13(spark, d):
    """Quotes are found again at their place: the occurrence that was stored is at the offset that was stored."""
    i = F.col("doc_id")
    docs = B.documents(spark, d).filter("length(text) > 60").select("doc_id", "text", F.substring("text", 21, 40).alias("quote"), F.when(i % 6 == 0, 19).otherwise(20).alias("start"))
    same = F.substring(F.col("text"), F.col("start") + 1, F.length("quote")) == F.col("quote")
    return docs.select("doc_id", F.when(same, "same").otherwise("moved").alias("audit"))


@query("EV15_case_selection", "SELECT item_id FROM benchmark WHERE item_id % 3 = 1 OR item_id IN (2, 5, 9)")
def ev15(spark, d):
    """The cases of a mode, and those that are named."""
    b = B.table(spark, d, "benchmark").select("item_id")
    return b.filter((F.col("item_id") % 3 == 1) | F.col("item_id").isin(2, 5, 9))


@query("OB8_trace_replay", B.RUNS_SQL + "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS seq, status FROM runs WHERE user_id % 10 = 3")
def ob8(spark, d):
    return R.top(B.runs(spark, d).filter("user_id % 10 = 3"), ["user_id"], ["created_at", "id"], 2**31 - 1, "seq").select("user_id", "id", "seq", "status")


@query("CV8_citation_consistency", """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(text || ' [S' || turn % 4 || '] and [S' || length(text) % 3 || ']', 'S\\d+'))), ',') AS inline, NOT list_contains(list_transform([turn % 4, length(text) % 3], lambda x: x < 2), FALSE) AS consistent FROM (SELECT * FROM conversations WHERE NOT regexp_matches(text, 'S\\d'))""")
def cv8(spark, d):
    c = B.table(spark, d, "conversations").filter(~F.rlike("text", F.lit(r"S\d")))
    answer = F.concat("text", F.lit(" [S"), s(F.col("turn") % 4), F.lit("] and [S"), s(F.length("text") % 3), F.lit("]"))
    inline = F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S\d+)\]"), F.lit(1))))
    registered = F.array(F.lit("S0"), F.lit("S1"))
    return c.select("conv_id", "turn", F.array_join(inline, ",").alias("inline"), (F.size(F.array_except(inline, registered)) == 0).alias("consistent"))


@query("CV9_request_dedupe", _RV + "SELECT learner, exercise AS request, min(ms) AS ms, arg_min(id, (ms, id)) AS id, count(*) - 1 AS repeats FROM rv GROUP BY learner, exercise")
def cv9(spark, d):
    first = F.struct("ms", "id")
    return rv(spark, d).groupBy("learner", F.col("exercise").alias("request")).agg(F.min("ms").alias("ms"), F.min_by("id", first).alias("id"), (F.count("*") - 1).alias("repeats"))


@query("CV4_budget_arithmetic", f"SELECT id, CASE WHEN w - 1000 - 500 - 200 < 1024 THEN 'too_small' WHEN k % 10 > 7 THEN 'too_many_recent' END AS fault, w - 1700 AS input_tokens FROM (SELECT event_id AS id, k, 2000 + k * 20 AS w FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))")
def cv4(spark, d):
    k = F.col("exercise")
    left = 2000 + k * 20 - 1000 - 500 - 200
    return rv(spark, d).select("id", F.when(left < 1024, "too_small").when(k % 10 > 7, "too_many_recent").alias("fault"), left.alias("input_tokens"))


@query("CV7_reference_candidates", _RV + "SELECT learner, exercise, n FROM (SELECT learner, exercise, row_number() OVER (PARTITION BY learner ORDER BY max(ms) DESC, exercise) AS n FROM rv WHERE unit < 7 GROUP BY learner, exercise) WHERE n <= 24")
def cv7(spark, d):
    """The 24 references that the covered turns used last."""
    last = rv(spark, d).filter("unit < 7").groupBy("learner", "exercise").agg(F.max("ms").alias("ms"))
    return R.top(last, ["learner"], [F.col("ms").desc(), "exercise"], 24, "n").select("learner", "exercise", "n")
