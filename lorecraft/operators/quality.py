"""Rules on generated study cards: each gives rows (candidate, code, field), and a card passes without any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the parts of a card may be, and phrases that say nothing.
KINDS = ["concept", "mechanism", "procedure", "fact"]
OBJECTIVE = "^能(?:解释|区分|判断|完成|识别).+"
ORIGINS = ["authored", "source"]
EXAMPLE_TYPES = ["example", "contrast", "steps", "illustration"]
EXERCISE_TYPES = ["choice", "recall"]
GENERIC = "只(?:把)?(?:背|记住|把名词背)|先收藏以后再说|以后再说|用自己的话解释它|最该先抓什么|先抓住最有用的那一点"
MAX_TITLE, MAX_EXPLANATION = 80, 320


def present(c: str | Column) -> Column:
    return F.trim(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))) != ""


def generic(c: str | Column) -> Column:
    return F.rlike(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), F.lit(GENERIC))


def issues(candidates: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, code, field) of the rules {code: (field, fails)} that a candidate fails, in one pass over the table."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(fails, F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))) for code, (field, fails) in rules.items()]))
    return candidates.select(key, F.explode(found).alias("i")).select(key, "i.code", "i.field")


def structural(candidates: DataFrame, key: str) -> DataFrame:
    """Issues of title, objective, summary, kind, example, exercise and answer of a candidate's fields."""
    has_example = present("example_text")
    return issues(
        candidates, key,
        {
            "title": ("title", ~present("title") | (F.length("title") > MAX_TITLE)), "objective": ("objective", ~F.rlike("objective", F.lit(OBJECTIVE))),
            "explanation": ("summary", ~present("summary") | generic("summary")), "knowledge_type": ("kind", ~F.col("kind").isin(KINDS)),
            "example": ("example_text", ~F.col("kind").eqNullSafe("fact") & ~has_example),
            "example_origin_missing": ("example_origin", has_example & ~F.coalesce(F.col("example_origin").isin(ORIGINS), F.lit(False))),
            "example_type": ("example_type", has_example & ~F.coalesce(F.col("example_type").isin(EXAMPLE_TYPES), F.lit(False))),
            "exercise": ("question", ~F.coalesce(F.col("exercise_type").isin(EXERCISE_TYPES), F.lit(False)) | ~present("question") | generic("question")),
            "answer": ("answer", ~present("answer") | ~present("explanation") | (F.size(F.coalesce("rubric", F.array().cast("array<string>"))) == 0) | ~F.forall("rubric", present)),
            "answer_explanation_long": ("explanation", F.coalesce(present("explanation") & (F.length("explanation") > MAX_EXPLANATION), F.lit(False))),
        },
    )


def choice(candidates: DataFrame, key: str) -> DataFrame:
    """Issues of choice questions: options, the key against the answer, and misconceptions of the wrong options."""
    n, key_at = F.size("options"), F.col("correct_index")
    at = F.get("options", key_at)
    wrong = F.transform("misconceptions", lambda m, i: (i != key_at) & ~present(m))
    fits = F.coalesce(F.size("misconceptions") == n, F.lit(False))
    return issues(
        candidates.filter("exercise_type = 'choice'"), key,
        {
            "options": ("options", ~n.between(2, 5) | ~F.forall("options", present) | F.exists("options", generic) | (F.size(F.array_distinct(F.transform("options", lambda o: F.trim(o)))) != n)),
            "answer_consistency": ("correct_index", (key_at < 0) | (key_at >= n) | ~F.col("answer").eqNullSafe(at)),
            "misconceptions": ("misconceptions", ~fits | F.exists(wrong, lambda w: w)),
            "correct_option_misconception": ("misconceptions", F.coalesce(present(F.get("misconceptions", key_at)), F.lit(False))),
        },
    )


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))


def new_numbers(candidates: DataFrame, key: str, example: str, source: str) -> DataFrame:
    """(key, extra): numbers of the example that the source doesn't have."""
    extra = F.array_sort(F.array_except(numbers(F.col(example)), numbers(F.col(source))))
    return candidates.select(key, F.array_join(extra, ",").alias("extra")).filter("extra <> ''")


def verdict_faults(candidates: DataFrame, verdicts: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, rule, fault): each required rule has exactly one verdict(key, rule, passed), and it passes."""
    wanted = candidates.select(key, F.explode(F.array(*[F.lit(r) for r in required])).alias("rule"))
    told = verdicts.groupBy(key, "rule").agg(F.count("*").alias("n"), F.bool_and("passed").alias("ok"))
    both = wanted.join(told, [key, "rule"], "left")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(~F.col("ok"), "failed")
    return both.select(key, "rule", fault.alias("fault")).filter("fault IS NOT NULL")


def rolled_up(candidates: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, issues, passed) of every candidate."""
    counts = found.groupBy(key).agg(F.count("*").alias("issues"))
    return candidates.select(key).join(counts, key, "left").select(key, F.coalesce("issues", F.lit(0)).alias("issues"), F.col("issues").isNull().alias("passed"))
