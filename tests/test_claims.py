"""The claim and clause rules by hand, every match of a text tried."""

from pyspark.sql import functions as F

from lorecraft.functions import text as X
from lorecraft.operators import claims as C
from lorecraft.operators import rules as U

FIELDS = "candidate long, field string, value string, option string"
EVIDENCE = "candidate long, source int, kind string, text string, observations array<string>, legend array<string>"


def issues(spark, rule, fields, evidence):
    f = spark.createDataFrame([(*x, None) if len(x) == 3 else x for x in fields], FIELDS)
    e = spark.createDataFrame([(c, 0, "text", t, None, None) if isinstance(t, str) or t is None else (c, 1, "image", None, *t) for c, t in evidence], EVIDENCE)
    return sorted(tuple(r) for r in rule(f, e).collect())


def test_places_of_matches(spark):
    d = spark.createDataFrame([("aXbbXX",), ("",), (None,), ("XaX",)], "t string")
    got = [[tuple(m) for m in r.m] for r in d.select(X.matches(F.col("t"), "X+").alias("m")).collect()]
    assert got == [[("X", 1), ("XX", 4)], [], [], [("X", 0), ("X", 2)]]


def test_boundaries(spark):
    said = [(1, "若 load <= limit 则通过，retries 为 3"), (2, "并非load 不超过 limit"), (3, None), (4, " ")]
    fields = [
        (1, "card.summary", "limit >= load，另外 load >= retries 且 retries ≤ load"), (1, "exercise.answer", "load <= limits"), (2, "card.summary", "阈值load不超过limit"), (2, "card.boundaries", "不能认为load <= limit"),
        (2, "exercise.misconceptions.0", "load <= limit：错", "load <= limit"), (3, "card.summary", "load <= limit"), (1, "card.boundaries", None),
    ]
    assert issues(spark, C.boundary_issues, fields, said) == [(1, "card.summary", "load >= retries"), (2, "card.summary", "load不超过limit")]
    assert not issues(spark, C.boundary_issues, [], said) and not issues(spark, C.boundary_issues, fields, [])


def test_conditions(spark):
    said = [(1, "缓存通常可以提升速度。"), (2, "用户可以向服务器提交。"), (3, "系统可能会停止，但一定会停止也有人说。"), (4, None)]
    fields = [
        (1, "card.summary", "不总是提升速度，但总是提升速度"), (1, "exercise.answer", "不得提升速度"), (2, "card.summary", "用户应该提交。"), (2, "exercise.answer", "应该提交表单"), (2, "card.boundaries", "响应提交"),
        (3, "card.summary", "一定会停止"), (2, "exercise.misconceptions.0", "以为用户必须提交，其实需要进行提交"), (4, "card.summary", "必须提交"),
    ]
    got = issues(spark, C.strengthened_conditions, fields, said)
    assert got == [
        (1, "card.summary", "通常可以提升速度", "总是提升速度", False, "literal"), (1, "exercise.answer", "通常可以提升速度", "不得提升速度", True, "literal"),
        (2, "card.summary", "可以向服务器提交", "应该提交", False, "omitted_modifier"), (2, "exercise.misconceptions.0", "可以向服务器提交", "需要进行提交", False, "omitted_modifier"),
    ]
    assert not issues(spark, C.strengthened_conditions, [], said)


def test_every_state_word_is_listed(spark):
    d = spark.createDataFrame([(w,) for w in C.state_names()], "w string")
    assert all(r.m == [r.w] for r in d.select("w", F.regexp_extract_all("w", F.lit(C.STATE), F.lit(0)).alias("m")).collect())


def test_image_claims(spark):
    seen = [(1, (["标签“A”"], None)), (1, "图注：B已修改。"), (2, (None, None)), (3, (["总是"], ["有数据"]))]
    fields = [(1, "card.summary", "没有依据说A已写入，不过A已回滚，总是如此"), (1, "card.boundaries", "B未修改，白框表示内存为空"), (2, "card.summary", "A已提交"), (3, "card.summary", "总是在左，说明磁盘有数据")]
    assert issues(spark, C.image_issues, fields, seen) == [
        (1, "card.boundaries", "image_claim_unverified", "表示内存为空"), (1, "card.summary", "image_claim_unverified", "已回滚"), (1, "card.summary", "image_scope_unverified", "总是"),
    ]


def test_later_matches_of_a_clause_count(spark):
    d = spark.createDataFrame([("不能缩短拍摄距离，但可以增加拍摄距离。", "返回 3，并非 返回 4")], "a string, b string")
    r = d.select(U.condition_issue(F.lit("景深"), F.lit("保持拍摄距离不变，怎样加大景深？"), F.col("a")).alias("c"), U.last_returned(F.col("b")).alias("n")).first()
    assert r.c == "question_condition_conflict" and r.n == 3
