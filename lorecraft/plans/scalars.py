"""Queries of single values and text helpers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.functions import text as X
from lorecraft.operators import scalars as V
from lorecraft.plans.registry import Registry

query = Registry()
_K = "(SELECT event_id AS id, event_type, value, ts, user_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"
_STOP = "['the', 'a', 'is', 'of', 'to', 'and']"


def keyed(spark, d):
    return B.table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "value", "ts", "user_id", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))


def pick(c, *values):
    """One of the values, by an integer column."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(c, F.lit(len(values))).cast("int"))


@query("FN1_normalize_text", "SELECT item_id, lower(text) AS normal FROM benchmark")
def fn1(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", X.normalize_text(F.col("text")).alias("normal"))


@query("FN9_synonym_tags", """SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text), 'cache') THEN 'synonym_0' END, CASE WHEN contains(lower(text), 'concurrency') THEN 'synonym_1' END, CASE WHEN contains(lower(text), 'recall') THEN 'synonym_3' END,
CASE WHEN contains(lower(text), 'idempotent') THEN 'synonym_4' END, CASE WHEN contains(lower(text), 'ttl') THEN 'synonym_5' END, CASE WHEN contains(lower(text), 'transaction') THEN 'synonym_6' END], lambda t: t IS NOT NULL), ' ') AS tags FROM documents""")
def fn9(spark, d):
    return B.documents(spark, d).select("doc_id", F.array_join(X.let(X.normalize_text(F.col("text")), X.synonym_tags), " ").alias("tags"))


@query("FN10_stop_words", f"SELECT item_id, len(w)::INT AS words, len(list_filter(w, lambda x: NOT list_contains({_STOP}, x)))::INT AS kept FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark)")
def fn10(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(X.LATIN), F.lit(0))
    return B.table(spark, d, "benchmark").select("item_id", words.alias("w")).select("item_id", F.size("w").alias("words"), F.size(F.filter("w", lambda x: ~x.isin(X.STOP_WORDS))).alias("kept"))


@query("FN12_token_similarity", """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(least(len(a.w), len(b.w)), 0), 0), 6) AS similarity FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def fn12(spark, d):
    c = B.table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.token_similarity(F.col("text"), F.col("after")), 6).alias("similarity"))


_PLANTED = "CASE doc_id % 4 WHEN 0 THEN '缓存是指一种存储。幂等指的是重复执行' WHEN 1 THEN '这是一个超过十个汉字的连续词语 并发，事务' WHEN 2 THEN '复习指回顾；召回是命中' ELSE '' END"
_KEY_TEXT = f"trim(regexp_replace(concat({_PLANTED}, chr(10), coalesce(text, '')), '[\\s\\x0B\\p{{Z}}]+', ' ', 'g'))"


@query("FN15_keywords", f"""SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:6], ' ') AS words FROM (
  SELECT doc_id, list_concat(list_concat(regexp_extract_all(t, '(?:^|[。！？；，,\\s])([\\x{{4e00}}-\\x{{9fff}}]{{2,10}})(?:是指|指的是|指|是)', 1), regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_-]{{2,}}')),
    list_filter(string_split_regex(regexp_replace(t, '[A-Za-z0-9_\\-，。！？、；：,.!?;:"''()（）\\[\\]【】]', ' ', 'g'), '\\s+'), lambda x: length(x) BETWEEN 2 AND 10)) AS w
  FROM (SELECT doc_id, {_KEY_TEXT} AS t FROM documents))""")
def fn15(spark, d):
    """Whole documents after a sentence with definitions or a long word."""
    planted = F.expr(f"concat({_PLANTED}, chr(10), coalesce(text, ''))")
    return B.documents(spark, d).select("doc_id", F.array_join(X.keywords(planted), " ").alias("words"))


@query("FN17_alias_coalesce", f"SELECT id, coalesce(nullif(CASE WHEN k % 3 = 0 THEN '' ELSE event_type END, ''), CASE WHEN k % 2 = 0 THEN 'u' || user_id END, 'none') AS value FROM {_K}")
def fn17(spark, d):
    k = F.col("k")
    first, second = F.when(k % 3 == 0, "").otherwise(F.col("event_type")), F.when(k % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return keyed(spark, d).select("id", V.first_present(first, second, F.lit("none")).alias("value"))


@query("FN19_options", """SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(text, ' ', '/'), '[|,，、/]'), lambda o: trim(regexp_replace(o, '\\s+', ' ', 'g'))), lambda o: o <> '')[1:5], '|') AS options FROM benchmark""")
def fn19(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", F.array_join(V.options(F.replace("text", F.lit(" "), F.lit("/"))), "|").alias("options"))


@query("FN20_correct_index", f"""SELECT id, CASE v WHEN 'A' THEN 0 WHEN 'b' THEN 1 WHEN 'C' THEN 2 WHEN '1' THEN 1 WHEN '3' THEN 2 WHEN '7' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS index FROM (SELECT id, ['A', 'b', 'C', '1', '3', '7', 'click', 'nothing', '-1', ''][k % 10 + 1] AS v FROM {_K})""")
def fn20(spark, d):
    key = pick(F.col("k"), "A", "b", "C", "1", "3", "7", "click", "nothing", "-1", "")
    return keyed(spark, d).select("id", V.correct_index(key, F.array(F.lit("view"), F.lit("click"), F.lit("error"))).alias("index"))


@query("FN21_bounded_numbers", f"SELECT id, CASE WHEN k % 7 = 0 THEN 5 ELSE greatest(1, least(20, floor(value / 10))) END::BIGINT AS goal, CASE WHEN k % 4 = 0 THEN 17 ELSE floor(value) END::BIGINT AS at FROM {_K}")
def fn21(spark, d):
    k, value = F.col("k"), F.col("value")
    goal = F.when(k % 7 == 0, "many").otherwise((value / 10).cast("string"))
    at = F.when(k % 8 == 0, "-3").when(k % 4 == 0, "never").otherwise(value.cast("string"))
    return keyed(spark, d).select("id", V.bounded_integer(goal, 1, 20, 5).alias("goal"), V.timestamp_ms(at, F.lit(17.9)).alias("at"))


@query("FN24_regions", f"SELECT id, greatest(0, least(1, (k - 20) / 60)) AS x, greatest(0, least(1, k / 120)) AS y, greatest(0, least(1, value / 60)) AS width, greatest(0, least(1, value / 120)) AS height FROM {_K}")
def fn24(spark, d):
    k = F.col("k")
    return keyed(spark, d).select("id", *V.region(k - 20, k, F.col("value"), F.col("value"), F.lit(60), F.lit(120)))


@query("FN27_usage", f"SELECT id, greatest(k - 5, 0) AS input, (user_id % 50)::BIGINT AS output, greatest(greatest(k - 5, 0) + user_id % 50, 60)::BIGINT AS total FROM {_K} WHERE k % 6 <> 0")
def fn27(spark, d):
    k, some = F.col("k"), F.col("k") % 6 != 0
    told = V.usage(F.when(some, k - 5), F.when(some, F.col("user_id") % 50), F.when(some, F.lit(60)))
    return keyed(spark, d).select("id", told.alias("u")).filter("u IS NOT NULL").select("id", "u.input", "u.output", "u.total")


_WRONG = ["忽略了条件", "把顺序弄反", "混淆两个概念", "凭感觉", "", "步骤的前提"]


@query("FN28_misconceptions", f"SELECT id, ['missing_prerequisite', 'step_order', 'concept_confusion', 'supported_misconception', 'unknown', 'missing_prerequisite'][k % 6 + 1] AS cause FROM {_K}")
def fn28(spark, d):
    return keyed(spark, d).select("id", V.misconception(pick(F.col("k"), *_WRONG)).alias("cause"))


@query("FN29_difficulty", f"SELECT id, ['foundation', 'foundation', 'challenge', 'standard', 'challenge', 'standard'][k % 6 + 1] AS difficulty FROM {_K}")
def fn29(spark, d):
    return keyed(spark, d).select("id", V.difficulty(pick(F.col("k"), " Beginner ", "入门", "ADVANCED", "hard", "挑战", "")).alias("difficulty"))


@query("FN31_objective", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '能区分' || substr(text, 1, 9) ELSE '能解释' || CASE WHEN item_id % 3 = 1 THEN '' ELSE '能够' END || substr(text, 1, 9) END AS objective FROM benchmark")
def fn31(spark, d):
    lead = pick(F.col("item_id"), "能区分", "理解", "能够")
    return B.table(spark, d, "benchmark").select("item_id", V.objective(F.concat(lead, F.substring("text", 1, 9))).alias("objective"))


@query("FN32_day_key", f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM {_K} GROUP BY 1")
def fn32(spark, d):
    return keyed(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"))


@query("FN34_scope", f"""SELECT id, CASE WHEN c IN ('unit_exclusion', 'self_familiarity') AND u <> '' THEN 'unit:' || u WHEN c IN ('topic_interest', 'difficulty_preference') AND t <> '' THEN 'topic:' || t WHEN kind = 'unit' AND u <> '' THEN 'unit:' || u WHEN kind = 'topic' AND t <> '' THEN 'topic:' || t ELSE 'global' END AS scope
FROM (SELECT id, ['unit_exclusion', 'topic_interest', 'learning_format', 'difficulty_preference', 'self_familiarity'][k % 5 + 1] AS c, ['unit', 'topic', 'global'][k % 3 + 1] AS kind, CASE WHEN k % 4 = 0 THEN '' ELSE 'u' || k END AS u, CASE WHEN k % 7 = 0 THEN '' ELSE 't' || user_id END AS t FROM {_K})""")
def fn34(spark, d):
    k = F.col("k")
    unit, topic = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string"))), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("t"), F.col("user_id").cast("string")))
    category = pick(k, "unit_exclusion", "topic_interest", "learning_format", "difficulty_preference", "self_familiarity")
    return keyed(spark, d).select("id", V.scope(category, pick(k, "unit", "topic", "global"), unit, topic).alias("scope"))


@query("DS11_preferred_difficulty", f"SELECT id, ['foundation', 'challenge', 'standard', NULL][k % 4 + 1] AS target FROM {_K}")
def ds11(spark, d):
    return keyed(spark, d).select("id", V.preferred_difficulty(pick(F.col("k"), "foundational", "advanced", "balanced", None)).alias("target"))


@query("DS13_target_key", "SELECT item_id, lower(substr(trim(regexp_replace(CASE WHEN item_id % 2 = 0 THEN substr(text, 1, 30) ELSE substr(text, 1, 10) || '|' || substr(text, 11, 40) || '|' || text END, '\\s+', ' ', 'g')), 1, 240)) AS key FROM benchmark")
def ds13(spark, d):
    part = lambda a, n: F.substring("text", a, n)
    concept = F.when(F.col("item_id") % 2 == 0, part(1, 30)).otherwise("")
    return B.table(spark, d, "benchmark").select("item_id", V.target_key(concept, part(1, 10), part(11, 40), F.col("text")).alias("key"))


@query("SRC1_default_filled", f"SELECT id, coalesce(CASE WHEN k % 3 <> 0 THEN k END, 0) AS count, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS tags, '' AS note FROM {_K}")
def src1(spark, d):
    """A table that lacks a column and has nulls, read under a full schema with defaults."""
    k = F.col("k")
    raw = keyed(spark, d).select("id", F.when(k % 3 != 0, k).alias("count"), F.when(k % 2 == 0, F.array(F.lit("x"))).alias("tags"))
    return V.filled(raw, {"id": ("long", None), "count": ("int", 0), "tags": ("array<string>", F.array().cast("array<string>")), "note": ("string", "")}).withColumn("tags", F.size("tags"))


@query("SRC12_public_projection", "SELECT doc_id, lang, source, n_chars FROM documents")
def src12(spark, d):
    return V.public(B.documents(spark, d))


@query("SRC14_manifest", """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN sha256('changed') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 4 <> 3)
SELECT d.doc_id, CASE WHEN m.sha IS NULL THEN 'unlisted' WHEN m.sha <> sha256(d.text) THEN 'changed' END AS fault FROM documents d LEFT JOIN m USING (doc_id) WHERE m.sha IS NULL OR m.sha <> sha256(d.text)""")
def src14(spark, d):
    docs, i = B.documents(spark, d).select("doc_id", "text"), F.col("doc_id")
    manifest = docs.filter(i % 4 != 3).select("doc_id", F.when(i % 10 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    return V.manifest_faults(docs, manifest, "doc_id", "text")
