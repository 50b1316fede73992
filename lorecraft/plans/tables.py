"""Queries of dashboards, memory, conversations, sources and plans, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import conversation as V
from lorecraft.operators import integrity as I
from lorecraft.operators import memory as M
from lorecraft.operators import observability as O
from lorecraft.operators import review as R
from lorecraft.plans.registry import Registry
from lorecraft.plans.review import _STREAK, NOW_MS

query = Registry()
_P95 = "quantile_disc(duration_ms, 0.95) FILTER (WHERE status IN ('completed', 'failed', 'cancelled') AND duration_ms >= 0)"
_DASH = f"""count(*) AS total_runs, count(*) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS terminal_runs, count(*) FILTER (WHERE status = 'completed') AS successful_runs,
 count(*) FILTER (WHERE retries > 0) AS retrying_runs, round(avg(steps), 6) AS average_steps, count(*) FILTER (WHERE approvals > 0) AS approval_runs, {_P95} AS p95_duration_ms,
 round(count(*) FILTER (WHERE status = 'completed') / nullif(count(*) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')), 0), 6) AS success_rate,
 round(count(*) FILTER (WHERE retries > 0) / count(*), 6) AS retry_rate, round(count(*) FILTER (WHERE approvals > 0) / count(*), 6) AS approval_rate"""


@query("OB1_run_dashboard", B.RUNS_SQL + f"SELECT skill, source, {_DASH} FROM runs WHERE created_at >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY skill, source")
def ob1(spark, d):
    return O.dashboard(O.selected(B.runs(spark, d), since="2024-01-24 00:00:00"), ["skill", "source"])


@query("OB2_p95", B.RUNS_SQL + f"SELECT skill, {_P95} AS p95_duration_ms FROM runs GROUP BY skill")
def ob2(spark, d):
    return O.dashboard(B.runs(spark, d), ["skill"]).select("skill", "p95_duration_ms")


@query("OB3_status_distribution", B.RUNS_SQL + "SELECT s AS status, count(runs.id) AS runs, round(count(runs.id) / (SELECT count(*) FROM runs), 6) AS rate FROM (VALUES ('queued'), ('running'), ('waiting_approval'), ('completed'), ('failed'), ('cancelled')) v(s) LEFT JOIN runs ON runs.status = s GROUP BY s")
def ob3(spark, d):
    return O.status_distribution(spark, B.runs(spark, d))


@query("OB4_error_distribution", B.RUNS_SQL + "SELECT error_code, count(*) AS n, round(count(*) / (SELECT count(*) FROM runs), 6) AS rate FROM runs WHERE error_code IS NOT NULL GROUP BY error_code")
def ob4(spark, d):
    return O.error_distribution(B.runs(spark, d))


@query("OB5_recent_runs", B.RUNS_SQL + "SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM runs) WHERE place <= 20")
def ob5(spark, d):
    return O.tail(B.runs(spark, d), "user_id", [F.col("created_at").desc(), F.col("id").desc()], 20).select("user_id", "id", "place")


@query("OB6_trace_sequence", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def ob6(spark, d):
    return O.trace_events(B.table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seq")


@query("OB7_run_upsert", B.RUNS_SQL + "SELECT user_id, min(id) AS created, arg_max(status, id) AS status, max(approvals) AS approvals, count(*) AS updates FROM runs GROUP BY user_id")
def ob7(spark, d):
    return O.run_upsert(B.runs(spark, d), "user_id", "id")


@query("OB9_audit_tail", "SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS place FROM events) WHERE place <= 200")
def ob9(spark, d):
    return O.tail(B.table(spark, d, "events"), "event_type", [F.col("event_id").desc()], 200).select("event_type", "event_id", "place")


@query("OB10_usage", B.RUNS_SQL + "SELECT skill, round(sum(CASE WHEN steps <> 0 THEN duration_ms END), 2) AS used, count(*) FILTER (WHERE steps = 0) AS missing FROM runs GROUP BY skill")
def ob10(spark, d):
    return B.runs(spark, d).groupBy("skill").agg(F.round(F.sum(F.when(F.col("steps") != 0, F.col("duration_ms"))), 2).alias("used"), F.count_if(F.col("steps") == 0).alias("missing"))


@query("OB11_budget_admission", B.RUNS_SQL + "SELECT id, round(used, 6) AS used_before, round(used, 6) < 500 AS admitted FROM (SELECT id, coalesce(sum(duration_ms) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM runs)")
def ob11(spark, d):
    return O.budget_admission(B.runs(spark, d), "user_id", ["created_at", "id"], "duration_ms", 500).select("id", "used_before", "admitted")


@query("EV8_distribution", "SELECT event_type, count(value) AS n, round(avg(value), 2) AS mean, round(median(value), 2) AS median, round(quantile_disc(value, 0.95), 2) AS p95, round(max(value), 2) AS most FROM events GROUP BY event_type")
def ev8(spark, d):
    return O.distribution(B.table(spark, d, "events"), ["event_type"], "value")


@query("EV9_category_rollup", "SELECT lang, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS matches FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def ev9(spark, d):
    both = B.table(spark, d, "labels").join(B.documents(spark, d).select("doc_id", "lang"), "doc_id")
    return both.groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("matches"))


@query("EV11_delivery_score", "SELECT lang, round(avg(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 1 + quality * 3 + (1 - toxic) END), 6) AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def ev11(spark, d):
    both = B.documents(spark, d).select("doc_id", "lang").join(B.table(spark, d, "labels"), "doc_id", "left")
    score = F.when(F.col("quality").isNull(), 1).otherwise(1 + F.col("quality") * 3 + (1 - F.col("toxic")))
    return both.groupBy("lang").agg(F.round(F.avg(score), 6).alias("score"))


@query("EV12_usage_cube", B.RUNS_SQL + "SELECT skill, status, count(*) AS requests, round(sum(duration_ms), 2) AS used FROM runs GROUP BY CUBE (skill, status)")
def ev12(spark, d):
    return B.runs(spark, d).cube("skill", "status").agg(F.count("*").alias("requests"), F.round(F.sum("duration_ms"), 2).alias("used"))


@query("EV14_stability", B.RUNS_SQL + "SELECT user_id, skill, count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS ready FROM runs GROUP BY user_id, skill")
def ev14(spark, d):
    return B.runs(spark, d).groupBy("user_id", "skill").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("ready"))


@query("EV16_match_without_space", "SELECT a.conv_id, a.turn, regexp_replace(a.text, '\\s+', '', 'g') = regexp_replace(b.text, '\\s+', '', 'g') AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def ev16(spark, d):
    m = B.table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s+", "").alias("t"))
    other = m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("o"))
    return m.join(other, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("t") == F.col("o")).alias("same"))


@query("ME1_unit_evidence", _STREAK + """, u AS (SELECT DISTINCT learner, n AS unit FROM rv, range(0, 12) r(n)), c AS (SELECT learner, (exercise % 12)::BIGINT AS unit, round(avg(exercise % 6), 6) AS legacy_mastery FROM rv WHERE event_type = 'signup' GROUP BY ALL)
SELECT u.learner, u.unit, CASE WHEN m.review_count > 0 THEN 'observed_review' WHEN legacy_mastery IS NOT NULL THEN 'legacy_card_state' ELSE 'absent' END AS origin, mastery_level, CASE WHEN m.review_count IS NULL THEN legacy_mastery END AS legacy_mastery
FROM u LEFT JOIN mast m ON m.learner = u.learner AND m.unit = u.unit LEFT JOIN c ON c.learner = u.learner AND c.unit = u.unit""")
def me1(spark, d):
    rv = B.review_events(spark, d)
    units = rv.select("learner").distinct().withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(11))))
    cards = rv.filter("event_type = 'signup'").select("learner", (F.col("exercise") % 12).alias("unit"), (F.col("exercise") % 6).alias("mastery"))
    return M.unit_evidence(units, R.mastery(rv), cards).withColumn("unit", F.col("unit").cast("long"))


@query("ME3_review_summary", _STREAK + "SELECT learner, count(*) AS units, sum(review_count)::BIGINT AS reviews, sum(incorrect_count)::BIGINT AS incorrect FROM mast GROUP BY learner")
def me3(spark, d):
    return R.mastery(B.review_events(spark, d)).groupBy("learner").agg(F.count("*").alias("units"), F.sum("review_count").alias("reviews"), F.sum("incorrect_count").alias("incorrect"))


@query("ME4_recent_events", B.RV_SQL + f"SELECT learner, id, place FROM (SELECT learner, id, row_number() OVER (PARTITION BY learner ORDER BY ms DESC, id DESC) AS place FROM rv WHERE ms >= {NOW_MS} - 7 * 86400000::BIGINT) WHERE place <= 8")
def me4(spark, d):
    return M.recent(B.review_events(spark, d), "learner", NOW_MS - 7 * R.DAY_MS, 8).select("learner", "id", "place")


@query("ME5_recorded_events", B.RV_SQL + ", m AS (SELECT learner, id, ms, 0 AS seq FROM rv UNION ALL SELECT learner, id, ms + 1, 1 FROM rv WHERE id % 7 = 0) SELECT learner, id, min(ms) AS ms, count(*) AS copies FROM m GROUP BY learner, id")
def me5(spark, d):
    rv = B.review_events(spark, d).select("learner", "id", "ms")
    both = rv.withColumn("seq", F.lit(0)).unionByName(rv.filter("id % 7 = 0").select("learner", "id", (F.col("ms") + 1).alias("ms"), F.lit(1).alias("seq")))
    return M.first_of_each(both, ["learner", "id"], ["seq"]).select("learner", "id", "ms", "copies")


def _changes(spark, d):
    rv = B.review_events(spark, d)
    return rv.select("learner", F.col("event_type").alias("category"), F.concat(F.lit("unit:"), (F.col("exercise") % 5).cast("string")).alias("scope_key"), (F.col("exercise") % 3).alias("value"), "ms", "id")


@query("ME6_preference_upsert", B.RV_SQL + "SELECT learner, event_type AS category, 'unit:' || CAST(exercise % 5 AS VARCHAR) AS scope_key, arg_max(exercise % 3, (ms, id)) AS value, count(*) AS version FROM rv GROUP BY ALL")
def me6(spark, d):
    return M.preferences(_changes(spark, d))


@query("ME7_interest_reconcile", B.RV_SQL + """, c AS (SELECT learner, unit, bool_or(correct) AS enabled FROM rv WHERE ms < 1705276800000 GROUP BY ALL), w AS (SELECT DISTINCT learner, unit FROM rv WHERE ms >= 1705276800000 AND correct)
SELECT coalesce(c.learner, w.learner) AS learner, coalesce(c.unit, w.unit) AS unit, CASE WHEN w.unit IS NOT NULL AND enabled IS NULL THEN 'insert' WHEN w.unit IS NOT NULL AND NOT enabled THEN 'enable' WHEN w.unit IS NULL AND enabled THEN 'disable' ELSE 'keep' END AS action
FROM c FULL JOIN w ON c.learner = w.learner AND c.unit = w.unit""")
def me7(spark, d):
    rv = B.review_events(spark, d)
    current = rv.filter("ms < 1705276800000").groupBy("learner", "unit").agg(F.bool_or("correct").alias("enabled"))
    return M.reconciled(current, rv.filter("ms >= 1705276800000 AND correct").select("learner", "unit").distinct(), ["learner", "unit"])


@query("ME8_interest_revision", B.RV_SQL + "SELECT learner, sha256(string_agg(l, chr(10) ORDER BY l)) AS revision FROM (SELECT learner, unit || '|' || count(*) || '|' || max(id) AS l FROM rv GROUP BY learner, unit) GROUP BY learner")
def me8(spark, d):
    items = B.review_events(spark, d).groupBy("learner", "unit").agg(F.count("*").alias("version"), F.max("id").alias("last_id"))
    return M.revision(items, "learner", ["unit", "version", "last_id"])


@query("ME10_memory_version", B.RV_SQL + "SELECT id, sum((event_type IN ('purchase', 'error'))::INT) OVER (PARTITION BY learner ORDER BY ms, id ROWS UNBOUNDED PRECEDING)::BIGINT AS version FROM rv")
def me10(spark, d):
    return M.memory_versions(B.review_events(spark, d).withColumn("changes", F.col("event_type").isin("purchase", "error"))).select("id", "version")


@query("ME16_favourite_changes", "SELECT doc_id, quality AS before, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS after FROM labels WHERE doc_id % 3 = 0")
def me16(spark, d):
    old = B.table(spark, d, "labels").select("doc_id", F.col("quality").alias("favourite"))
    new = old.withColumn("favourite", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("favourite")).otherwise(F.col("favourite")))
    return M.changed(old, new, "doc_id", "favourite")


@query("DS10_scoped_preferences", B.RV_SQL + """, p AS (SELECT learner, CASE exercise % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'topic' ELSE 'unit' END AS scope, CASE exercise % 3 WHEN 1 THEN exercise % 4 WHEN 2 THEN exercise % 10 END AS scope_id, exercise AS value, ms, id, CASE exercise % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS r FROM rv WHERE event_type = 'signup'),
t AS (SELECT DISTINCT learner, unit % 4 AS topic, unit FROM rv)
SELECT t.learner, t.topic, t.unit, arg_max(p.value, (r, ms, p.id)) AS value FROM t LEFT JOIN p ON p.learner = t.learner AND (scope = 'global' OR (scope = 'topic' AND scope_id = t.topic) OR (scope = 'unit' AND scope_id = t.unit)) GROUP BY t.learner, t.topic, t.unit""")
def ds10(spark, d):
    rv, x = B.review_events(spark, d), F.col("exercise")
    p = rv.filter("event_type = 'signup'").select(
        "learner", F.get(F.array(F.lit("global"), F.lit("topic"), F.lit("unit")), x % 3).alias("scope"), F.when(x % 3 == 1, x % 4).when(x % 3 == 2, x % 10).alias("scope_id"), x.alias("value"), "ms", "id"
    )
    return M.scoped(p, rv.select("learner", (F.col("unit") % 4).alias("topic"), "unit").distinct())


@query("CV1_turn_pairs", """WITH g AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations)
SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS user_turn, min(turn) FILTER (WHERE role = 'assistant') AS assistant_turn FROM g WHERE g > 0 GROUP BY conv_id, g HAVING min(turn) FILTER (WHERE role = 'assistant') IS NOT NULL""")
def cv1(spark, d):
    return V.turn_pairs(B.table(spark, d, "conversations"))


def _sized(spark, d):
    m = B.table(spark, d, "conversations")
    size = m.select("conv_id", F.col("turn").alias("assistant_turn"), F.length("text").alias("size"))
    return V.turn_pairs(m).join(size, ["conv_id", "assistant_turn"])


_PAIRS = """WITH g AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations),
p0 AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS user_turn, min(turn) FILTER (WHERE role = 'assistant') AS assistant_turn FROM g WHERE g > 0 GROUP BY conv_id, g HAVING min(turn) FILTER (WHERE role = 'assistant') IS NOT NULL),
p AS (SELECT p0.*, length(text) AS size FROM p0 JOIN conversations c ON c.conv_id = p0.conv_id AND c.turn = assistant_turn)
"""


@query("CV2_history_tail", _PAIRS + "SELECT conv_id, user_turn, back, used FROM (SELECT *, row_number() OVER w AS back, sum(size) OVER (PARTITION BY conv_id ORDER BY user_turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY user_turn DESC)) WHERE back <= 12 AND used <= 1500")
def cv2(spark, d):
    return V.history_tail(_sized(spark, d), "size", 12, 1500).select("conv_id", "user_turn", "back", "used")


@query("CV5_compaction", _PAIRS + """, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY user_turn) AS n, sum(size) OVER (PARTITION BY conv_id ORDER BY user_turn ROWS UNBOUNDED PRECEDING) AS prefix, count(*) OVER (PARTITION BY conv_id) AS pairs, sum(size) OVER (PARTITION BY conv_id) AS total FROM p)
SELECT conv_id, pairs, total::BIGINT AS size, pairs > 2 OR total * 10 >= 8 * 2000 AS triggered, CASE WHEN pairs > 2 OR total * 10 >= 8 * 2000 THEN count(*) FILTER (WHERE n <= pairs - 1 AND prefix <= 2000) ELSE 0 END AS covered FROM n GROUP BY conv_id, pairs, total""")
def cv5(spark, d):
    return V.compaction(_sized(spark, d), "size", 2, 1, 2000)


@query("CV11_session_quota", "SELECT conv_id, count(*) FILTER (WHERE p <= 3) AS accepted, count(*) FILTER (WHERE p > 3) AS refused FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id")
def cv11(spark, d):
    return V.quotas(B.table(spark, d, "conversations"), 3)


@query("SRC6_asset_dedupe", "SELECT 'asset_' || sha256(text) AS asset_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def src6(spark, d):
    return B.documents(spark, d).groupBy(F.concat(F.lit("asset_"), F.sha2("text", 256)).alias("asset_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SRC7_document_ingest", "SELECT doc_id, substr(source, 1, 256) AS title, substr(text, 1, 262144) AS content, octet_length(encode(substr(text, 1, 262144)))::BIGINT AS byte_size FROM documents WHERE trim(text) <> ''")
def src7(spark, d):
    content = F.substring("text", 1, 262144)
    own = B.documents(spark, d).filter(F.trim("text") != "")
    return own.select("doc_id", F.substring("source", 1, 256).alias("title"), content.alias("content"), F.octet_length(content).cast("long").alias("byte_size"))


@query("SRC8_versioned_update", """WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 1 WHEN n.doc_id IS NULL OR o.text = n.text THEN 3 ELSE 4 END AS version, CASE WHEN o.doc_id IS NULL THEN 'inserted' WHEN n.doc_id IS NULL THEN 'kept' WHEN o.text = n.text THEN 'same' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def src8(spark, d):
    docs, i = B.documents(spark, d).select("doc_id", "text"), F.col("doc_id")
    new = docs.filter(i % 10 != 1).withColumn("text", F.when(i % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return I.versioned_update(docs.filter(i % 10 != 0).withColumn("version", F.lit(3)), new, "doc_id", "text")


@query("SRC9_payload_split", "SELECT sha256(text || chr(31) || lang) AS payload_id, count(*) AS rows_of FROM documents GROUP BY 1")
def src9(spark, d):
    index, _ = I.payload_split(B.documents(spark, d).select("doc_id", "text", "lang"), "doc_id", ["text", "lang"])
    return index.groupBy("payload_id").agg(F.count("*").alias("rows_of"))


@query("SRC10_hydrate", "SELECT doc_id, lang, length(text)::INT AS n FROM documents")
def src10(spark, d):
    index, payloads = I.payload_split(B.documents(spark, d).select("doc_id", "text", "lang"), "doc_id", ["text", "lang"])
    return I.hydrated(index, payloads).select("doc_id", "lang", F.length("text").alias("n"))


@query("SRC11_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def src11(spark, d):
    refs = [B.table(spark, d, "labels").select("doc_id"), B.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))]
    return I.orphans(B.documents(spark, d).select("doc_id"), "doc_id", refs)


@query("SRC4_url_gate", "SELECT page_id, substr(trim(url), 1, 2048) AS url FROM pages WHERE regexp_matches(trim(url), '^https?://')")
def src4(spark, d):
    return B.table(spark, d, "pages").filter(F.rlike(F.trim("url"), F.lit("^https?://"))).select("page_id", F.substring(F.trim("url"), 1, 2048).alias("url"))


@query("M3_missing_sources", "SELECT 'source_' || doc_id AS source_id, doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def m3(spark, d):
    return I.missing_sources(B.documents(spark, d).select(F.col("doc_id").alias("document_id")), B.table(spark, d, "labels").select(F.col("doc_id").alias("document_id")))


@query("M4_source_status", """WITH s AS (SELECT doc_id AS source_id, doc_id + CASE WHEN doc_id % 5 = 0 THEN 10000000 ELSE 0 END AS document_id, CASE WHEN toxic = 1 THEN 'excerpt' ELSE 'full_text' END AS retention FROM labels)
SELECT source_id, CASE WHEN d.doc_id IS NOT NULL THEN 'available' WHEN retention = 'excerpt' THEN 'excerpt_only' ELSE 'removed' END AS status, CASE WHEN retention = 'excerpt' THEN 'excerpt' WHEN d.doc_id % 2 = 0 THEN 'original' ELSE 'full_text' END AS retention FROM s LEFT JOIN documents d ON d.doc_id = document_id""")
def m4(spark, d):
    i = F.col("doc_id")
    sources = B.table(spark, d, "labels").select(i.alias("source_id"), (i + F.when(i % 5 == 0, 10000000).otherwise(0)).alias("document_id"), F.when(F.col("toxic") == 1, "excerpt").otherwise("full_text").alias("retention"))
    return I.source_status(sources, B.documents(spark, d).select(i.alias("document_id"), (i % 2 == 0).alias("original")))


@query("M9_event_enrichment", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END, o_custkey) AS topic FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def m9(spark, d):
    rows = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("topic"))
    dimension = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("topic"))
    return I.null_filled(rows, dimension, "l_orderkey", ["topic"])


@query("M14_unreferenced_sources", "SELECT DISTINCT l_partkey AS source_id FROM lineitem WHERE l_orderkey % 3 = 0 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 3 <> 0)")
def m14(spark, d):
    cards = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("card_id"), F.col("l_partkey").alias("source_id"))
    return I.unreferenced_after_delete(cards, cards.filter("card_id % 3 = 0").select("card_id").distinct())


@query("M22_session_recency", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def m22(spark, d):
    return B.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


def _edges(spark, d):
    n = F.col("l_linenumber") % 4
    kind = F.get(F.array(*[F.lit(x) for x in ("prerequisite", "comparison", "application", "other")]), n)
    return B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plan"), (F.col("l_partkey") % 50).alias("source"), (F.col("l_orderkey") % 50).alias("target"), kind.alias("type"))


TYPES = ["prerequisite", "comparison", "application"]
_EDGES = """WITH e AS (SELECT DISTINCT l_suppkey AS plan, l_partkey % 50 AS source, l_orderkey % 50 AS target, CASE l_linenumber % 4 WHEN 0 THEN 'prerequisite' WHEN 1 THEN 'comparison' WHEN 2 THEN 'application' ELSE 'other' END AS type FROM lineitem),
r AS (SELECT * FROM e WHERE type <> 'other' AND source <> target)
"""


@query("PL3_relations", _EDGES + "SELECT * FROM r")
def pl3(spark, d):
    return I.relations(_edges(spark, d), TYPES)


@query("PL6_reshape_edges", _EDGES + """, m AS (SELECT n AS old, n - 1 AS new FROM range(1, 50, 10) t(n) UNION ALL SELECT n AS old, n + 100 AS new FROM range(1, 50, 10) t(n))
SELECT DISTINCT plan, source, target, type FROM (SELECT plan, coalesce(a.new, source) AS source, coalesce(b.new, target) AS target, type FROM r LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = target) WHERE source <> target""")
def pl6(spark, d):
    edges = I.relations(_edges(spark, d), TYPES)
    old = edges.select(F.col("source").alias("old")).unionByName(edges.select(F.col("target").alias("old"))).distinct().filter("old % 10 = 1")
    mapping = old.withColumn("new", F.explode(F.array(F.col("old") - 1, F.col("old") + 100)))
    return I.rewritten(edges, mapping)


@query("PL12_neighbourhood", _EDGES + """, b AS (SELECT plan, source AS unit, target AS other, type FROM r UNION ALL SELECT plan, target, source, type FROM r) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan, unit ORDER BY other, type) AS place FROM b) WHERE place <= 8""")
def pl12(spark, d):
    return I.neighbourhood(I.relations(_edges(spark, d), TYPES), 8)


@query("PL14_plan_status", B.RUNS_SQL + ", p AS (SELECT user_id * 1000 + (id % 97) AS plan, status FROM runs) SELECT plan, CASE WHEN bool_and(status = 'completed') THEN 'ready' WHEN bool_or(status = 'failed') THEN 'needs_attention' ELSE 'paused' END AS status, count(*) AS parts FROM p GROUP BY plan")
def pl14(spark, d):
    return I.plan_status(B.runs(spark, d).select((F.col("user_id") * 1000 + F.col("id") % 97).alias("plan"), "status"))


@query("PL1_coverage_violations", """WITH c AS (SELECT DISTINCT conv_id AS plan, turn AS chunk FROM conversations), v AS (SELECT conv_id AS plan, turn + CASE WHEN turn % 7 = 6 THEN 100 ELSE 0 END AS chunk, CASE WHEN turn % 3 <> 0 THEN turn END AS unit, CASE WHEN turn % 2 = 0 THEN 'r' END AS reason FROM conversations WHERE turn % 5 <> 4 UNION ALL SELECT conv_id, turn, turn, NULL FROM conversations WHERE (conv_id + turn) % 11 = 0),
n AS (SELECT plan, chunk, count(*) AS n, bool_or(unit IS NULL AND reason IS NULL) AS unexplained FROM v GROUP BY ALL)
SELECT * FROM (SELECT coalesce(c.plan, n.plan) AS plan, coalesce(c.chunk, n.chunk) AS chunk, CASE WHEN c.plan IS NULL THEN 'unknown_chunk' WHEN n IS NULL THEN 'uncovered' WHEN n > 1 THEN 'covered_twice' WHEN unexplained THEN 'no_reason' END AS fault FROM c FULL JOIN n ON c.plan = n.plan AND c.chunk = n.chunk) WHERE fault IS NOT NULL""")
def pl1(spark, d):
    m, t = B.table(spark, d, "conversations"), F.col("turn")
    chunks = m.select(F.col("conv_id").alias("plan"), t.alias("chunk")).distinct()
    first = m.filter(t % 5 != 4).select(F.col("conv_id").alias("plan"), (t + F.when(t % 7 == 6, 100).otherwise(0)).alias("chunk"), F.when(t % 3 != 0, t).alias("unit"), F.when(t % 2 == 0, "r").alias("reason"))
    again = m.filter((F.col("conv_id") + t) % 11 == 0).select(F.col("conv_id").alias("plan"), t.alias("chunk"), t.alias("unit"), F.lit(None).cast("string").alias("reason"))
    return I.coverage_violations(chunks, first.unionByName(again))


@query("PL2_merged_units", "SELECT lang AS plan, regexp_replace(lower(substr(text, 1, 6)), '[\\s\\p{P}]+', '', 'g') AS objective, min(doc_id) AS unit, string_agg(DISTINCT source, ',' ORDER BY source) AS evidence FROM documents GROUP BY 1, 2")
def pl2(spark, d):
    units = B.documents(spark, d).select(F.col("lang").alias("plan"), F.col("doc_id").alias("unit"), "text", F.col("source").alias("evidence"))
    return I.merged_units(units, F.substring("text", 1, 6))
