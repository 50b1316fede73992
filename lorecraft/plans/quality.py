"""Card rules over candidates made of benchmark items with a field dropped or changed here and there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import quality as Q
from lorecraft.plans.registry import Registry

query = Registry()
_C = """WITH c AS (SELECT item_id AS id, CASE WHEN item_id % 7 = 0 THEN '' ELSE substr(text, 1, (60 + item_id % 40)::INT) END AS title, CASE item_id % 5 WHEN 0 THEN '理解' WHEN 1 THEN '能' ELSE '能解释' END || substr(text, 1, 20) AS objective,
 CASE WHEN item_id % 11 = 0 THEN NULL WHEN item_id % 13 = 0 THEN '先收藏以后再说' ELSE text END AS summary, ['concept', 'procedure', 'other', 'fact'][(item_id % 4)::INT + 1] AS kind, CASE WHEN item_id % 3 <> 0 THEN substr(text, 10, 40) END AS example_text,
 ['authored', 'source', 'copied'][(item_id % 3)::INT + 1] AS example_origin, ['example', 'contrast', 'steps', 'illustration', 'story'][(item_id % 5)::INT + 1] AS example_type, ['choice', 'recall', 'essay', 'choice', 'choice'][(item_id % 5)::INT + 1] AS exercise_type,
 CASE WHEN item_id % 17 = 0 THEN '最该先抓什么' ELSE substr(text, 1, 50) || '?' END AS question, CASE item_id % 6 WHEN 0 THEN [substr(text, 1, 5), ' ' || substr(text, 1, 5)] WHEN 1 THEN [substr(text, 1, 5), '以后再说', 'x'] WHEN 2 THEN [substr(text, 1, 5)] ELSE [substr(text, 1, 5), substr(text, 8, 5), substr(text, 20, 5)] END AS options,
 (item_id % 4)::INT AS correct_index, substr(text, 1, 5) AS answer, CASE WHEN item_id % 9 <> 0 THEN 1 ELSE 0 END AS rubric_n, text || substr(text, 1, 100) AS explanation, CASE item_id % 8 WHEN 0 THEN ['a'] WHEN 1 THEN ['', 'b', 'c'] ELSE ['a', '', 'c'] END AS misconceptions, text FROM benchmark)
"""
_S = """, s AS (SELECT id, 'title' AS code, 'title' AS field FROM c WHERE trim(title) = '' OR length(title) > 80 UNION ALL SELECT id, 'objective', 'objective' FROM c WHERE NOT regexp_matches(objective, '^能(解释|区分|判断|完成|识别).+')
 UNION ALL SELECT id, 'explanation', 'summary' FROM c WHERE coalesce(summary, '') = '' OR contains(summary, '以后再说') UNION ALL SELECT id, 'knowledge_type', 'kind' FROM c WHERE kind NOT IN ('concept', 'mechanism', 'procedure', 'fact')
 UNION ALL SELECT id, 'example', 'example_text' FROM c WHERE kind <> 'fact' AND trim(coalesce(example_text, '')) = '' UNION ALL SELECT id, 'example_origin_missing', 'example_origin' FROM c WHERE trim(coalesce(example_text, '')) <> '' AND example_origin = 'copied'
 UNION ALL SELECT id, 'example_type', 'example_type' FROM c WHERE trim(coalesce(example_text, '')) <> '' AND example_type = 'story' UNION ALL SELECT id, 'exercise', 'question' FROM c WHERE exercise_type = 'essay' OR question = '最该先抓什么'
 UNION ALL SELECT id, 'answer', 'answer' FROM c WHERE trim(answer) = '' OR rubric_n = 0 UNION ALL SELECT id, 'answer_explanation_long', 'explanation' FROM c WHERE length(explanation) > 320)
"""
_O = """, o AS (SELECT *, list_transform(options, lambda x: trim(x)) AS t, options[correct_index + 1] AS a FROM c WHERE exercise_type = 'choice'), h AS (SELECT id, 'options' AS code, 'options' AS field FROM o WHERE len(options) NOT BETWEEN 2 AND 5 OR list_contains(t, '') OR list_contains(options, '以后再说') OR len(list_distinct(t)) < len(options)
 UNION ALL SELECT id, 'answer_consistency', 'correct_index' FROM o WHERE a IS NULL OR a <> answer UNION ALL SELECT id, 'misconceptions', 'misconceptions' FROM o WHERE len(misconceptions) <> len(options) OR len(list_filter(range(len(misconceptions)), lambda i: i <> correct_index AND misconceptions[i + 1] = '')) > 0
 UNION ALL SELECT id, 'correct_option_misconception', 'misconceptions' FROM o WHERE coalesce(misconceptions[correct_index + 1], '') <> '')
"""


def candidates(spark, d):
    i, part = F.col("item_id"), lambda a, n: F.substring("text", a, n)
    pick = lambda *names: F.get(F.array(*[F.lit(k) for k in names]), (i % len(names)).cast("int"))
    options = (
        F.when(i % 6 == 0, F.array(part(1, 5), F.concat(F.lit(" "), part(1, 5)))).when(i % 6 == 1, F.array(part(1, 5), F.lit("以后再说"), F.lit("x")))
        .when(i % 6 == 2, F.array(part(1, 5))).otherwise(F.array(part(1, 5), part(8, 5), part(20, 5)))
    )
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return B.table(spark, d, "benchmark").select(
        i.alias("id"), F.when(i % 7 == 0, "").otherwise(F.substring(F.col("text"), F.lit(1), (60 + i % 40).cast("int"))).alias("title"),
        F.concat(F.when(i % 5 == 0, "理解").when(i % 5 == 1, "能").otherwise("能解释"), part(1, 20)).alias("objective"),
        F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, "先收藏以后再说").otherwise(F.col("text")).alias("summary"), pick("concept", "procedure", "other", "fact").alias("kind"),
        F.when(i % 3 != 0, part(10, 40)).alias("example_text"), pick("authored", "source", "copied").alias("example_origin"), pick("example", "contrast", "steps", "illustration", "story").alias("example_type"),
        pick("choice", "recall", "essay", "choice", "choice").alias("exercise_type"), F.when(i % 17 == 0, "最该先抓什么").otherwise(F.concat(part(1, 50), F.lit("?"))).alias("question"),
        options.alias("options"), (i % 4).cast("int").alias("correct_index"), part(1, 5).alias("answer"), F.when(i % 9 != 0, F.array(F.lit("r"))).alias("rubric"), F.concat("text", part(1, 100)).alias("explanation"),
        F.when(i % 8 == 0, words("a")).when(i % 8 == 1, words("", "b", "c")).otherwise(words("a", "", "c")).alias("misconceptions"), "text",
    )


@query("QA1_structural", _C + _S + "SELECT * FROM s")
def qa1(spark, d):
    return Q.structural(candidates(spark, d), "id")


@query("QA2_choice", _C + _O + "SELECT * FROM h")
def qa2(spark, d):
    return Q.choice(candidates(spark, d), "id")


@query("QA20_new_numbers", """WITH n AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS e, list_distinct(regexp_extract_all(substr(text, 1, 500), '\\d+(?:\\.\\d+)?')) AS s FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(s, x))), ',') AS extra FROM n WHERE len(list_filter(e, lambda x: NOT list_contains(s, x))) > 0""")
def qa20(spark, d):
    """Numbers of a document that its first 500 characters don't have."""
    return Q.new_numbers(B.documents(spark, d).select("doc_id", "text", F.substring("text", 1, 500).alias("source")), "doc_id", "text", "source")


@query("QA21_verdicts", """WITH w AS (SELECT doc_id, unnest(['quality', 'toxic', 'language']) AS rule FROM documents), v AS (SELECT doc_id, 'quality' AS rule, quality = 1 AS passed FROM labels UNION ALL SELECT doc_id, 'toxic', toxic = 0 FROM labels UNION ALL SELECT doc_id, 'toxic', TRUE FROM labels WHERE doc_id % 13 = 0 UNION ALL SELECT doc_id, 'language', lang = 'en' FROM documents),
t AS (SELECT doc_id, rule, count(*) AS n, bool_and(passed) AS ok FROM v GROUP BY ALL) SELECT * FROM (SELECT w.doc_id, w.rule, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN NOT ok THEN 'failed' END AS fault FROM w LEFT JOIN t ON t.doc_id = w.doc_id AND t.rule = w.rule) WHERE fault IS NOT NULL""")
def qa21(spark, d):
    labels, docs = B.table(spark, d, "labels"), B.documents(spark, d)
    v = lambda df, rule, ok: df.select("doc_id", F.lit(rule).alias("rule"), ok.alias("passed"))
    verdicts = v(labels, "quality", F.col("quality") == 1).unionByName(v(labels, "toxic", F.col("toxic") == 0)).unionByName(v(labels.filter("doc_id % 13 = 0"), "toxic", F.lit(True))).unionByName(v(docs, "language", F.col("lang") == "en"))
    return Q.verdict_faults(docs, verdicts, "doc_id", ["quality", "toxic", "language"])


@query("QA24_roll_up", _C + _S + _O + "SELECT c.id, count(x.id) AS issues, count(x.id) = 0 AS passed FROM c LEFT JOIN (SELECT id FROM s UNION ALL SELECT id FROM h) x ON x.id = c.id GROUP BY c.id")
def qa24(spark, d):
    c = candidates(spark, d)
    return Q.rolled_up(c, Q.structural(c, "id").unionByName(Q.choice(c, "id")), "id")


@query("QA31_rule_statistics", _C + _S + "SELECT kind, code, count(*) AS issues FROM s JOIN c ON c.id = s.id GROUP BY kind, code")
def qa31(spark, d):
    c = candidates(spark, d)
    return Q.structural(c, "id").join(c.select("id", "kind"), "id").groupBy("kind", "code").agg(F.count("*").alias("issues"))
