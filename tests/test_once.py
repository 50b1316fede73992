"""What is worked out once: relations of a text, pairs and rounds of diverse picks."""

from lorecraft.operators import claims as C
from lorecraft.operators import targets as T
from lorecraft.plans import targets as P


def test_words_of_texts_are_no_rows(spark):
    f = spark.createDataFrame([(1, "card.summary", "limit >= load，另外 load >= retries", None), (2, "card.summary", "a-b- <= c", None)], "candidate long, field string, value string, option string")
    e = spark.createDataFrame([(1, 0, "text", "若 load <= limit，retries 为 3"), (2, 0, "text", "a-b- c")], "candidate long, source int, kind string, text string")
    out = C.boundary_issues(f, e)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
    assert sorted(tuple(r) for r in out.collect()) == [(1, "card.summary", "load >= retries"), (2, "card.summary", "a-b- <= c")]


def test_rounds_of_picks_read_written_pairs(spark, monkeypatch):
    tables, real = [], T.kept
    monkeypatch.setattr(T, "kept", lambda *t: tables.extend(t) or real(*t))
    out = P.ds19(spark, "/root/testdata/sf0.001")
    assert len(tables) == 4
    assert out.count() > 0
