"""Queries of card rules, sources, outlines and references, and their SQL.

The texts of the rules are picked from a few sentences by a number of each row; the SQL states
what each of them must give.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.functions import text as X
from lorecraft.operators import discovery as D
from lorecraft.operators import library as L
from lorecraft.operators import retrieval as R
from lorecraft.operators import review as V
from lorecraft.operators import rules as U
from lorecraft.plans.discovery import _grams
from lorecraft.plans.registry import Registry
from lorecraft.plans.retrieval import _OVER, bm25, overlap
from lorecraft.plans.review import _STREAK, NOW_MS
from lorecraft.plans.scalars import pick
from lorecraft.plans.texts import semantic

query = Registry()
_I = "SELECT event_id AS id, {} AS issue FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"


def rows(spark, d):
    return B.review_events(spark, d).select("id", F.col("exercise").alias("k"))


def told(*codes) -> str:
    """SQL of the code that each sentence must give, by k."""
    return _I.format("[" + ", ".join(f"'{c}'" if c else "NULL" for c in codes) + f"][k % {len(codes)} + 1]")


@query("QA8_numeric_mismatch", told("numeric_answer_mismatch", None, None, None))
def qa8(spark, d):
    k = F.col("k")
    question = pick(k, "连续调用两次后返回什么", "第二次调用返回什么", "返回什么", "连续调用后返回什么")
    answer, why = pick(k, "返回 3", "返回值为2", "返回 3", "返回 4"), pick(k, "先返回 3，最后返回4", "第二次返回 2", "返回 9", "不是返回 5，而是返回 4")
    return rows(spark, d).select("id", F.when(U.numeric_mismatch(question, answer, why), "numeric_answer_mismatch").alias("issue"))


@query("QA12_sorting", told("exercise_answer_leak", "sorting_priority_ambiguous", None, None))
def qa12(spark, d):
    k = F.col("k")
    question = pick(k, "先按次要键排，再按主要键排，应是什么顺序？", "先按姓名排序，再按年龄排序，怎么做？", "先按次要键再按主要键是否正确？什么顺序", "怎么实现稳定排序？")
    return rows(spark, d).select("id", U.sorting_issue(F.lit("稳定排序保持相等元素的次序"), question, pick(k, "先次后主", "先按年龄排序，然后再按姓名排序", "是", "用归并")).alias("issue"))


@query("QA13_conditions", told("question_condition_conflict", None, "finite_sample_unverified", None, None, None))
def qa13(spark, d):
    k = F.col("k")
    source = pick(k, "景深取决于光圈", "景深取决于光圈", "中心极限定理说的是极限", "中心极限定理说的是极限", "景深", "别的材料")
    question = pick(k, "保持拍摄距离不变，怎样加大景深？", "保持拍摄距离不变，怎样加大景深？", "样本均值近似正态吗？", "若误差不超过 0.1，近似吗？", "怎样加大景深？", "问")
    value = pick(k, "可以缩短拍摄距离。", "不能缩短拍摄距离，应收小光圈。", "因为样本量为30已足够大。", "因为样本量为30已足够大。", "可以缩短拍摄距离。", "样本量为30已足够大")
    return rows(spark, d).select("id", U.condition_issue(source, question, value).alias("issue"))


@query("QA14_transactions", told("transaction_context", None, None, None))
def qa14(spark, d):
    k = F.col("k")
    source = pick(k, "SQLite 的事务是原子的", "SQLite 的事务是原子的", "SQLite 的事务是原子的，隔离级别另说", "PostgreSQL 的事务是原子的")
    value = pick(k, "此时另一个事务看到旧值。", "材料未说明另一个事务看到什么。", "此时另一个事务看到旧值。", "此时另一个事务看到旧值。")
    return rows(spark, d).select("id", U.transaction_issue(source, value).alias("issue"))


@query("QA15_terms", told("term_conflation", None, None, "term_conflation"))
def qa15(spark, d):
    value = pick(F.col("k"), "准确率（灵敏度）为 90%", "不能说灵敏度就是准确率", "灵敏度为 90%", "其中灵敏度即检测准确率。另说")
    return rows(spark, d).select("id", U.term_issue(value).alias("issue"))


@query("QA19_continuation", told("task_continuation_scope", None, None, None))
def qa19(spark, d):
    k = F.col("k")
    source = pick(k, "Promise.all 遇错即拒", "Promise.all 遇错即拒", "Promise.all 遇错即拒", "别的材料")
    value = pick(k, "其他任务仍会继续执行。", "尚未完成的其他任务会继续执行", "其他任务会继续运行的说法不成立", "其他任务会继续运行")
    return rows(spark, d).select("id", U.continuation_issue(source, value).alias("issue"))


# ---- sources


@query("SRC2_text_files", "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND trim(text) <> '' THEN sha256(text) END AS sha FROM documents")
def src2(spark, d):
    """Files in three encodings, some with a NUL; their text comes back with plain line ends."""
    i = F.col("doc_id")
    text = F.when(i % 7 == 0, F.concat("text", F.lit("\x00"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r\n")))
    mark = lambda h, c: F.concat(F.unhex(F.lit(h)), F.encode(text, c))
    content = F.when(i % 3 == 0, mark("FFFE", "UTF-16LE")).when(i % 3 == 1, mark("FEFF", "UTF-16BE")).otherwise(F.encode(text, "UTF-8"))
    return B.documents(spark, d).select("doc_id", content.alias("content")).select("doc_id", F.sha2(U.decoded(F.col("content")), 256).alias("sha"))


@query("SRC3_page_texts")
def src3(spark, d):
    return U.page_texts(B.table(spark, d, "pages"), "page_id", "html")


@query("SRC5_file_kinds", "SELECT doc_id, [NULL, 'not_pdf', NULL, 'not_docx', NULL, 'kind'][doc_id % 6 + 1] AS fault FROM documents")
def src5(spark, d):
    i = F.col("doc_id")
    name = F.concat(F.lit("f"), i.cast("string"), pick(i, ".pdf", ".PDF", ".docx", ".docx", ".md", ".exe"))
    content = F.encode(F.concat(pick(i, "x%PDF-1.7", "none", "PK", "zip", "#", "MZ"), "text"), "UTF-8")
    return B.documents(spark, d).select("doc_id", U.file_fault(name, content).alias("fault"))


@query("SRC13_report_rows", B.RUNS_SQL + """, c AS (SELECT skill, count(*)::DOUBLE AS runs, sum(steps)::DOUBLE AS steps, sum(retries)::DOUBLE AS retries FROM runs GROUP BY skill)
SELECT skill, 'runs' AS metric, runs AS value FROM c UNION ALL SELECT skill, 'steps', steps FROM c UNION ALL SELECT skill, 'retries', retries FROM c""")
def src13(spark, d):
    c = B.runs(spark, d).groupBy("skill").agg(F.count("*").cast("double").alias("runs"), F.sum("steps").cast("double").alias("steps"), F.sum("retries").cast("double").alias("retries"))
    return U.metric_rows(c, "skill", ["runs", "steps", "retries"])


# ---- recommendation


_PAIR = f"WITH b AS (SELECT item_id, item_id % 3 AS base, {semantic('substr(text, 1, 40)')} AS t, {semantic('text')} AS s, {semantic('substr(text, 1, 12)')} AS n FROM benchmark), g AS (SELECT *, {_grams('t')} AS gt, {_grams('s')} AS gs, {_grams('n')} AS gn FROM b)\n"
_SIM = "len(list_intersect({0}, {1})) / sqrt(nullif(len({0}) * len({1}), 0))"


def _items(spark, d):
    part = lambda n: X.semantic_text(F.substring("text", 1, n) if n else F.col("text"), clean=X.collapse)
    b = B.table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 3).alias("base"), part(40).alias("t"), part(0).alias("s"), part(12).alias("n"))
    grams = lambda c: F.array_distinct(X.ngrams(F.col(c)))
    return b.select("*", grams("t").alias("gt"), grams("s").alias("gs"), grams("n").alias("gn"))


@query("DS4_similarity", _PAIR + f"SELECT a.item_id, round(CASE WHEN a.s = b.s THEN 1 ELSE coalesce({_SIM.format('a.gs', 'b.gs')}, 0) END, 6) AS similarity FROM g a JOIN g b ON b.item_id = a.item_id + 1 - (a.item_id % 4 = 0)::INT")
def ds4(spark, d):
    """Each item with the next one, every fourth with itself."""
    i = _items(spark, d)
    other = i.select(F.col("item_id").alias("_o"), F.col("s").alias("s2"), F.col("gs").alias("gs2"))
    both = i.withColumn("_o", F.col("item_id") + F.when(F.col("item_id") % 4 == 0, 0).otherwise(1)).join(other, "_o")
    return both.select("item_id", F.round(U.similarity(F.col("s"), F.col("s2"), F.col("gs"), F.col("gs2")), 6).alias("similarity"))


@query("DS5_same_target", _PAIR + f"""SELECT a.item_id, (a.item_id % 5 = 0 AND b.item_id % 5 = 0) OR (NOT (a.base <> b.base AND len(a.gn) > 0 AND len(b.gn) > 0 AND coalesce({_SIM.format('a.gn', 'b.gn')}, 0) < 0.65) AND coalesce({_SIM.format('a.gt', 'b.gt')}, 0) >= 0.86 AND coalesce({_SIM.format('a.gs', 'b.gs')}, 0) >= 0.86) AS same
FROM g a JOIN g b ON b.item_id = CASE WHEN a.item_id % 3 = 0 THEN a.item_id WHEN a.item_id % 5 = 0 THEN a.item_id + 5 ELSE a.item_id + 1 END""")
def ds5(spark, d):
    i = _items(spark, d)
    one = i.select("item_id", F.struct(F.when(F.col("item_id") % 5 == 0, "fives").otherwise("").alias("concept"), F.col("gt").alias("topic_grams"), F.col("gs").alias("target_grams"), F.col("gn").alias("anchor_grams"), F.col("base").alias("base_topic")).alias("x"))
    k = F.col("item_id")
    met = one.withColumn("_o", F.when(k % 3 == 0, k).when(k % 5 == 0, k + 5).otherwise(k + 1)).join(one.select(k.alias("_o"), F.col("x").alias("y")), "_o")
    return met.select("item_id", U.same_target("x", "y").alias("same"))


@query("DS12_outlines", "SELECT item_id, CASE WHEN item_id % 6 = 0 THEN 'unknown_seed' WHEN item_id % 5 = 0 THEN 'topic' WHEN item_id % 7 = 0 THEN 'objective' WHEN item_id % 11 = 0 THEN 'new_knowledge' WHEN length(text) < 120 THEN 'knowledge_text' END AS fault FROM benchmark")
def ds12(spark, d):
    i, part = F.col("item_id"), lambda n: F.substring("text", 1, n)
    knowledge = F.when(F.length("text") < 120, part(40)).otherwise(F.col("text"))
    return B.table(spark, d, "benchmark").select("item_id", U.outline_fault(i % 6 != 0, F.when(i % 5 == 0, part(3)).otherwise(part(20)), F.when(i % 7 == 0, part(7)).otherwise(part(30)), F.when(i % 11 == 0, part(5)).otherwise(part(30)), knowledge).alias("fault"))


@query("DS26_promises", _PAIR + "SELECT a.item_id, array_to_string(list_filter([CASE WHEN len(a.gn) > 0 AND len(list_intersect(a.gn, b.gs)) / len(a.gn) < 0.18 THEN 'discovery_objective' END, CASE WHEN len(a.gt) > 0 AND len(list_intersect(a.gt, b.gs)) / len(a.gt) < 0.18 THEN 'discovery_novelty' END], lambda x: x IS NOT NULL), ',') AS issues FROM g a JOIN g b ON b.item_id = a.item_id + 1 - (a.item_id % 2)")
def ds26(spark, d):
    i = _items(spark, d)
    other = i.select(F.col("item_id").alias("_o"), F.col("gs").alias("gs2"))
    both = i.withColumn("_o", F.col("item_id") + 1 - F.col("item_id") % 2).join(other, "_o")
    return both.select("item_id", F.array_join(U.promise_issues(F.col("gn"), F.col("gt"), F.col("gs2")), ",").alias("issues"))


@query("RV19_recall_exercises", """SELECT item_id, sha256(substr(trim(regexp_replace(CASE WHEN item_id % 3 = 0 THEN substr(text, 1, 30) ELSE text END, '\\s+', ' ', 'g')), 1, 2000)) AS answer, CASE WHEN item_id % 4 = 0 THEN 2 ELSE 1 END AS points FROM benchmark WHERE item_id % 7 <> 0""")
def rv19(spark, d):
    """A recall exercise for each card that has none yet."""
    i = F.col("item_id")
    title = X.collapse(F.substring("text", 1, 30), 30)
    cards = B.table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 30).alias("title"), F.when(i % 4 != 0, F.lit("能解释一件事")).otherwise("").alias("objective"), F.when(i % 3 != 0, F.col("text")).alias("summary"))
    done = cards.filter("item_id % 7 = 0").select("item_id")
    own = cards.join(done, "item_id", "left_anti")
    told = own.select("item_id", *U.recall_exercise(F.concat(F.lit("u:"), i.cast("string")), F.col("title"), F.col("objective"), F.lit(""), [F.col("summary"), F.col("title")]))
    return told.select("item_id", F.sha2("answer", 256).alias("answer"), F.size("rubric").alias("points"))


# ---- references


@query("RT28_valid_references", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id % 4 <> 0 WHEN 1 THEN doc_id % 5 <> 0 ELSE doc_id % 5 <> 0 AND doc_id % 4 <> 0 END AS valid FROM documents WHERE length(text) > 80""")
def rt28(spark, d):
    i, text = F.col("doc_id"), F.col("text")
    docs = B.documents(spark, d).filter("length(text) > 80")
    quote = F.when(i % 4 == 0, F.when(i % 3 == 1, F.substring("text", 31, 20)).otherwise("never said so")).otherwise(F.substring("text", 31, 20))
    version = F.when(i % 5 == 0, 2).otherwise(1)
    kind = pick(i, "context", "card", "document")
    return docs.select("doc_id", U.valid_reference(kind, text, text, F.lit(1), text, F.lit(1), quote, F.lit(30), version).alias("valid"))


@query("RT25_usable_citations", """WITH c AS (SELECT doc_id // 8 AS card, doc_id AS citation, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS rank FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0) SELECT * FROM c WHERE rank <= 3""")
def rt25(spark, d):
    i, docs = F.col("doc_id"), B.documents(spark, d)
    c = docs.select(F.floor(i / 8).alias("card"), i.alias("citation"), "doc_id", F.when(i % 3 == 0, 2).otherwise(1).alias("version"), F.lit(0).alias("start"), F.when(i % 7 == 0, "never said so").otherwise(F.substring("text", 1, 10)).alias("quote"))
    sources = docs.select("doc_id", F.lit(1).alias("version"), F.when(i % 5 == 0, "removed").otherwise("available").alias("status"), F.col("text").alias("content"))
    return U.usable_citations(c, sources, "card").select("card", "citation", "rank")


@query("ME2_learning_context", _STREAK + f""", e AS (SELECT learner, count(*) AS units, sum(review_count)::BIGINT AS reviews, sum(incorrect_count)::BIGINT AS incorrect FROM mast GROUP BY learner), f AS (SELECT learner, least(count(*), 60) AS facts FROM rv WHERE ms >= {NOW_MS} - 30 * 86400000::BIGINT GROUP BY learner),
p AS (SELECT learner, count(*) FILTER (WHERE exercise % 5 = 0) AS interests, count(*) FILTER (WHERE exercise % 5 = 1) AS downranked, count(*) FILTER (WHERE exercise % 5 = 2) AS excluded FROM rv WHERE event_type = 'signup' AND exercise % 4 <> 0 GROUP BY learner)
SELECT e.*, coalesce(facts, 0) AS facts, coalesce(interests, 0) AS interests, coalesce(downranked, 0) AS downranked, coalesce(excluded, 0) AS excluded FROM e LEFT JOIN f USING (learner) LEFT JOIN p USING (learner)""")
def me2(spark, d):
    """What recommendations know of each learner: evidence, recent facts (60 at most) and preferences by category."""
    from lorecraft.plans.library import preferences

    rv = B.review_events(spark, d)
    evidence = V.mastery(rv).groupBy("learner").agg(F.count("*").alias("units"), F.sum("review_count").alias("reviews"), F.sum("incorrect_count").alias("incorrect"))
    facts = rv.filter(F.col("ms") >= NOW_MS - 30 * L.DAY_MS).groupBy("learner").agg(F.least(F.count("*"), F.lit(60)).alias("facts"))
    of = lambda c: F.count_if(F.col("category") == c)
    p = preferences(spark, d).filter("enabled").groupBy("learner").agg(of("topic_interest").alias("interests"), of("topic_downrank").alias("downranked"), of("unit_exclusion").alias("excluded"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return evidence.join(facts, "learner", "left").join(p, "learner", "left").select("learner", "units", "reviews", "incorrect", *[zero(c) for c in ("facts", "interests", "downranked", "excluded")])


# ---- strategies


#: Retrieval strategies by name: (term overlap, BM25), which are made where they are called, -> (query_id, doc_id, score).
STRATEGIES = {
    "lexical": lambda lexical, ranked: lexical().select("query_id", "doc_id", "score"),
    "bm25": lambda lexical, ranked: ranked(),
    "bm25_gated": lambda lexical, ranked: ranked().join(lexical().select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"),
}


@query("EV5_strategy_matrix", _OVER + "SELECT 'lexical' AS strategy, query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM over WHERE score >= 0.18) WHERE rank <= 3")
def ev5_lexical(spark, d):
    """The lexical row of the matrix, which SQL can state briefly; EV5_all_strategies has every row."""
    return strategy_matrix(spark, d, {"lexical": STRATEGIES["lexical"]})


def strategy_matrix(spark, d, strategies, k=3):
    """(strategy, query_id, doc_id, rank) of all strategies in one long table; what several of them search by is made once."""
    lexical, ranked = cache(lambda: overlap(spark, d, R.OVERLAP_LEAST)), cache(lambda: bm25(spark, d))
    parts = [R.top(f(lexical, ranked), ["query_id"], [F.col("score").desc(), "doc_id"], k).select(F.lit(name).alias("strategy"), "query_id", "doc_id", "rank") for name, f in strategies.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("UX1_all_strategies")
def ux1(spark, d):
    return strategy_matrix(spark, d, STRATEGIES)


# ---- cards, citations and conversations


@query("FN22_clean_cards", """SELECT 'c_' || doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN '知识点' ELSE 'Title ' || doc_id END AS title, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) AS source, CASE WHEN doc_id % 3 = 0 THEN '#00FFaa' ELSE '#111111' END AS color, doc_id % 2 = 0 AS favorite,
least(5, doc_id % 9)::BIGINT AS mastery, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id END::BIGINT AS review_count, '2024-01-02' AS day FROM documents""")
def fn22(spark, d):
    i = F.col("doc_id")
    cards = B.documents(spark, d).select(
        F.concat(F.lit("c "), i.cast("string")).alias("id"), F.when(i % 6 == 0, "  ").otherwise(F.concat(F.lit(" Title  "), i.cast("string"))).alias("title"), F.col("text").alias("source"), F.lit("s").alias("summary"),
        pick(i, "#00FFaa", "red", "#12345").alias("color"), F.when(i % 2 == 0, F.lit(True)).alias("favorite"), (i % 9).cast("string").alias("mastery"), F.when(i % 4 == 0, "many").otherwise(i.cast("string")).alias("review_count"), F.lit("2024-01-02T03:04").alias("day"),
    )
    return U.clean_card(cards, "#111111").drop("summary")


@query("FN23_valid_citations", """WITH c AS (SELECT doc_id // 12 AS card, doc_id AS place, 'citation_' || doc_id % 7 AS id, CASE WHEN doc_id % 11 = 0 THEN 'colour' ELSE 'summary' END AS claim, length(trim(substr(text, 1, 20))) = 20 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS good, row_number() OVER (PARTITION BY doc_id // 12 ORDER BY doc_id) AS n FROM documents)
SELECT card, id, min(place) AS place FROM c WHERE n <= 8 AND good GROUP BY card, id""")
def fn23(spark, d):
    i = F.col("doc_id")
    c = B.documents(spark, d).select(
        F.floor(i / 12).alias("card"), i.alias("place"), F.concat(F.lit("citation_"), (i % 7).cast("string")).alias("id"), F.lit("chunk_1").alias("chunk"), F.concat(F.lit("doc_"), i.cast("string")).alias("doc"), F.when(i % 11 == 0, "colour").otherwise("summary").alias("claim"),
        F.lit("text").alias("type"), F.lit("t").alias("title"), F.when(i % 13 == 0, "ftp://x").otherwise(F.lit(None)).alias("url"), F.substring("text", 1, 20).alias("quote"), F.lit(0).alias("start"), F.when(i % 5 == 0, 21).otherwise(20).alias("end"), F.lit(None).cast("int").alias("page"),
    )
    return U.valid_citations(c, "card").select("card", "id", "place")


@query("CV6_summary_validity", "SELECT conv_id, turn, turn % 4 <> 0 AND turn % 3 <> 2 AND length(text) <= 400 AND conv_id % 5 <> 0 AS valid FROM conversations")
def cv6(spark, d):
    t = F.col("turn")
    items = F.when(t % 4 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("a"), F.lit("b")))
    keys = F.when(t % 3 == 2, F.array(F.lit("k9"))).otherwise(F.array(F.lit("k1")))
    valid = U.summary_valid(F.col("text"), [items], keys, F.array(F.lit("k1"), F.lit("k2")), t, F.when(F.col("conv_id") % 5 == 0, t + 1).otherwise(t))
    return B.table(spark, d, "conversations").select("conv_id", "turn", valid.alias("valid"))


@query("CV10_practice_phase", "SELECT event_id AS id, [NULL, 'phase', 'hints_lowered', NULL, 'hints_at_start', 'question_hidden', 'phase', 'hints'][CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 8 + 1] AS fault FROM events")
def cv10(spark, d):
    k = F.col("k")
    phase = pick(k, "awaiting_answer", "awaiting_answer", "awaiting_answer", "explaining", "awaiting_answer", "awaiting_answer", "explaining", "explaining")
    question = pick(k, "What is it?", None, "What is it?", None, "What else?", "What else?", "What is it?", None)
    hints = pick(k, 2, 0, 0, 0, 1, 0, 0, 9)
    return rows(spark, d).select("id", U.practice_fault(phase, question, hints, F.lit("What is it?"), F.lit(1), F.when(k % 8 == 4, "So: **What else?**").otherwise("Think.")).alias("fault"))


@query("DS16_reasons", "SELECT event_id AS id, CASE WHEN k % 3 = 0 THEN 'interest' ELSE 'interest,difficulty_preference:' || CASE WHEN k % 3 = k % 2 + 1 THEN 'as_preferred' ELSE 'downranked' END END AS reasons FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)")
def ds16(spark, d):
    k = F.col("k")
    reasons = U.reasons_of(F.lit("interest"), F.when(k % 3 != 0, k), k % 3, k % 2 + 1)
    text = F.transform(reasons, lambda r: F.concat_ws(":", r["code"], r["fits"]))
    return rows(spark, d).select("id", F.array_join(text, ",").alias("reasons"))


@query("RT30_evidence_bundle", _OVER + """, m AS (SELECT o.query_id, o.doc_id, o.score, CASE WHEN o.doc_id % 7 = 0 THEN 'never said so' ELSE substr(d.text, 1, 30) END AS quote, d.text FROM over o JOIN documents d USING (doc_id) WHERE o.score >= 0.18),
r AS (SELECT query_id, 'material' AS origin, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM m WHERE doc_id % 7 <> 0 AND doc_id % 2 = 0 UNION ALL SELECT query_id, 'related', doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM m WHERE doc_id % 7 <> 0 AND doc_id % 2 = 1)
SELECT query_id, origin, doc_id FROM r WHERE n <= CASE origin WHEN 'material' THEN 3 ELSE 5 END""")
def rt30(spark, d):
    docs = B.documents(spark, d).select("doc_id", F.col("text").alias("content"))
    hits = overlap(spark, d).filter(F.col("score") >= R.OVERLAP_LEAST).select("query_id", "doc_id", "score").join(docs, "doc_id")
    hits = hits.select("query_id", "doc_id", "score", F.lit(0).alias("start"), F.when(F.col("doc_id") % 7 == 0, "never said so").otherwise(F.substring("content", 1, 30)).alias("quote"))
    return U.evidence_bundle({"material": (hits.filter("doc_id % 2 = 0"), 3), "related": (hits.filter("doc_id % 2 = 1"), 5)}, docs, "query_id").select("query_id", "origin", "doc_id")


@query("RT31_variant_sources", B.RV_SQL + """, p AS (SELECT learner, exercise AS doc_id, unit AS start, unit + 9 AS "end", min(ms * 1000 + id % 1000) AS f FROM rv GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY f) AS n FROM p)
SELECT learner, id FROM (SELECT rv.learner, rv.id, row_number() OVER (PARTITION BY rv.learner ORDER BY ms * 1000 + rv.id % 1000) AS m FROM rv JOIN k ON k.learner = rv.learner AND k.doc_id = exercise AND k.start = unit AND n <= 8) WHERE m <= 32""")
def rt31(spark, d):
    refs = B.review_events(spark, d).select("learner", "id", F.col("exercise").alias("doc_id"), F.col("unit").alias("start"), (F.col("unit") + 9).alias("end"), (F.col("ms") * 1000 + F.col("id") % 1000).alias("place"))
    return U.variant_sources(refs, "learner").select("learner", "id")


@query("EV6_heading_ablation", _OVER.replace("lower(text) AS t", "lower(source || ' ' || text) AS t").replace("list_distinct(list_concat(list_filter(regexp_extract_all(lower(text)", "list_distinct(list_concat(list_filter(regexp_extract_all(lower(source || ' ' || text)").replace("contains(lower(text),", "contains(lower(source || ' ' || text),") + "SELECT query_id, count(*) AS hits, max(score) AS best FROM over WHERE score >= 0.18 GROUP BY query_id")
def ev6(spark, d):
    """The lexical search with headings (the source's name) in front of each text; RT1 is the search without them."""
    docs = B.documents(spark, d).select("doc_id", F.concat_ws(" ", "source", "text").alias("text"))
    hits = R.overlap(B.queries(spark, d), docs, "doc_id", X.normalize_text(F.col("text")), X.normalize_text(F.col("query")))
    return hits.filter(F.col("score") >= R.OVERLAP_LEAST).groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


@query("QA4_evidence", """WITH r AS (SELECT doc_id // 10 AS card, doc_id, ['summary', 'exercise', 'colour', 'example'][doc_id % 4 + 1] AS claim, CASE WHEN doc_id % 7 = 0 THEN 'never said so' ELSE substr(text, 5, 20) END AS quote, text FROM documents WHERE length(text) > 30),
l AS (SELECT *, CASE WHEN claim <> 'colour' AND trim(quote) <> '' AND contains(text, quote) THEN doc_id END AS hit FROM r), p AS (SELECT card, count(*) > count(hit) AS lost, count(DISTINCT hit) > 6 AS spread, count(*) FILTER (WHERE hit IS NOT NULL AND claim = 'summary') = 0 OR count(*) FILTER (WHERE hit IS NOT NULL AND claim = 'exercise') = 0 AS missing FROM l GROUP BY card)
SELECT card, 'evidence_location' AS code FROM p WHERE lost UNION ALL SELECT card, 'evidence_limit' FROM p WHERE spread UNION ALL SELECT card, 'evidence_coverage' FROM p WHERE missing""")
def qa4(spark, d):
    i = F.col("doc_id")
    docs = B.documents(spark, d).filter("length(text) > 30")
    refs = docs.select(F.floor(i / 10).alias("card"), i.alias("place"), pick(i, "summary", "exercise", "colour", "example").alias("claim"), i.alias("source"), F.when(i % 7 == 0, "never said so").otherwise(F.substring("text", 5, 20)).alias("quote"))
    return U.evidence_issues(refs, docs.select(i.alias("source"), "text"), "card", ["summary", "exercise"], places=6)


@query("QA16_image_leak", told("image_answer_leak", None, "image_answer_leak", None, None))
def qa16(spark, d):
    k = F.col("k")
    seen = F.lit('图中有“Input”、“Hidden”、“Output”三块')
    question = pick(k, "从左到右依次是 Input、Hidden、Output，分别是什么？", "最右侧区域叫什么？", "标签为 Input 的区域对应哪一块？", "从左到右依次是 Input、Hidden、Output，是否正确吗？", "从左到右依次是 Input、Hidden、Output，分别是什么？")
    return rows(spark, d).select("id", U.image_leak(pick(k, "学", "学", "学", "学", "翻译标签"), seen, question, F.lit("左边是 Input")).alias("issue"))


_HASHED = """WITH t AS (SELECT doc_id AS id, trim(regexp_replace(lower(text), '[\\s\\x0B\\p{Z}]+', ' ', 'g')) AS t FROM documents),
g AS (SELECT id, (unicode(substr(t, i, 1))::BIGINT * 2654435761 + unicode(substr(t, i + 1, 1))::BIGINT * 2246822519) % 4294967296 AS h FROM (SELECT id, t, unnest(range(1, length(t))) AS i FROM t)),
p AS (SELECT id, (h // 65536) % 64 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS n FROM g GROUP BY ALL)
"""


@query("UX2_embeddings", _HASHED + "SELECT id AS doc_id, 'hashed-bigrams-64' AS model, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM p QUALIFY n <> 0")
def ux2(spark, d):
    """Vectors of whole texts by the default embedding, a row for each number; any other object with `fingerprint`, `dimensions` and `embed` fits as well."""
    told = U.embedded(B.documents(spark, d), "doc_id", "text")
    return told.select("doc_id", "model", F.posexplode("embedding").alias("place", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))


#: Rule sets by version: the codes that a task asks for and their patterns.
RULE_SETS = {"v1": {"long_digits": r"\d{3,}"}, "v2": {"long_digits": r"\d{3,}", "question": r"\?"}}


@query("UX4_rule_sets", "SELECT doc_id, 'v2' AS version, code FROM (SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '[0-9]{3,}') THEN 'long_digits' END, CASE WHEN contains(text, '?') THEN 'question' END], lambda x: x IS NOT NULL)) AS code FROM documents)")
def ux4(spark, d):
    """The rules of a version over the fields of a table; another version is another entry of RULE_SETS."""
    from lorecraft.operators.upkeep import flagged

    fields = B.documents(spark, d).select(F.col("doc_id").alias("key"), F.lit("text").alias("field"), F.col("text").alias("value"))
    return flagged(fields, RULE_SETS["v2"]).select(F.col("key").alias("doc_id"), F.lit("v2").alias("version"), "code")


@query("UX3_similarity_strategies", _PAIR + f"SELECT a.item_id, round(CASE WHEN a.s = b.s THEN 1 WHEN a.item_id % 2 = 0 THEN greatest(0, least(1, list_cosine_similarity(va.embedding::DOUBLE[], vb.embedding::DOUBLE[]))) ELSE coalesce({_SIM.format('a.gs', 'b.gs')}, 0) END, 6) AS similarity FROM g a JOIN g b ON b.item_id = a.item_id + 1 JOIN embeddings va ON va.vec_id = a.item_id JOIN embeddings vb ON vb.vec_id = b.item_id")
def ux3(spark, d):
    """Vectors where both items have one (the even ones here), shared bigrams otherwise."""
    v = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    i = _items(spark, d).join(v, "item_id")
    other = i.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("s2"), F.col("gs").alias("gs2"), F.col("embedding").alias("e2"))
    mine = F.when(F.col("item_id") % 2 == 0, F.col("embedding"))
    return i.join(other, "item_id").select("item_id", F.round(U.similarity(F.col("s"), F.col("s2"), F.col("gs"), F.col("gs2"), mine, F.col("e2")), 6).alias("similarity"))
