"""Clean-up of single values: options, keys, usage, scopes, difficulties and error causes, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.functions import text as X

# Words of the causes of an error, tried in this order, and of the difficulties.
MISCONCEPTIONS = [("missing_prerequisite", "前提|条件|忽略|缺少|漏掉|未考虑"), ("step_order", "顺序|先后|步骤|次序"), ("concept_confusion", "混淆|混为|当成|误把|区别|不区分")]
FOUNDATION = ["foundation", "foundational", "beginner", "入门"]
CHALLENGE = ["challenge", "advanced", "进阶", "挑战"]
OBJECTIVE_VERBS = "^能(?:解释|区分|判断|完成|识别)"
UNIT_CATEGORIES, TOPIC_CATEGORIES = ["unit_exclusion", "self_familiarity"], ["topic_interest", "topic_downrank", "difficulty_preference"]
OPTION_MARKS = r"[|,，、/]"
MAX_OPTIONS, LAST_INDEX = 5, 2


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def options(text: Column) -> Column:
    """The options of a delimited text: trimmed, without empty ones, five at most."""
    parts = F.transform(F.split(text, OPTION_MARKS), squeezed)
    return F.slice(F.filter(parts, lambda o: o != ""), 1, MAX_OPTIONS)


def correct_index(value: Column, choices: Column) -> Column:
    """The index that a key stands for: a letter A to C, a number from 0 or, past 2, from 1, else the option of that text, else 0."""
    text = squeezed(value)
    number = text.try_cast("double")
    bounded = lambda n: F.greatest(F.lit(0.0), F.least(n, F.lit(float(LAST_INDEX))))
    numeric = bounded(F.when(number.between(0, LAST_INDEX), number).otherwise(number - 1))
    place = F.array_position(choices, text) - 1
    return F.when(F.rlike(text, F.lit("^[A-Ca-c]$")), (F.ascii(F.upper(text)) - 65).cast("double")).when(number.isNotNull(), numeric).when(place >= 0, place.cast("double")).otherwise(F.lit(0.0)).cast("int")


def bounded_integer(value: Column, low: int, high: int, fallback: int) -> Column:
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), F.floor(number)))).otherwise(F.lit(fallback)).cast("long")


def timestamp_ms(value: Column, fallback: Column) -> Column:
    """A time of 0 or more as a whole number, else the fallback as one."""
    number = value.try_cast("double")
    return F.when(number >= 0, F.floor(number)).otherwise(F.greatest(F.lit(0), F.floor(F.coalesce(fallback.try_cast("double"), F.lit(0.0))))).cast("long")


def region(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """A box of a page as shares of the page, each from 0 to 1."""
    clamp = lambda v, n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / n))
    return [clamp(x, width).alias("x"), clamp(y, height).alias("y"), clamp(w, width).alias("width"), clamp(h, height).alias("height")]


def usage(inputs: Column, outputs: Column, total: Column) -> Column:
    """Tokens of a request from whatever was reported; null where nothing was."""
    given = lambda c: c.isNotNull() & (c >= 0)
    zero = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    told = F.struct(zero(inputs).alias("input"), zero(outputs).alias("output"), F.greatest(zero(inputs) + zero(outputs), F.coalesce(total, F.lit(0))).alias("total"))
    return F.when(given(inputs) | given(outputs) | given(total), told)


def misconception(text: Column) -> Column:
    """What kind of error a misconception describes."""
    own = F.trim(X.nfkc(F.coalesce(text, F.lit(""))))
    return reduce(lambda c, r: c.when(F.rlike(own, F.lit(r[1])), r[0]), MISCONCEPTIONS, F.when(own == "", "unknown")).otherwise("supported_misconception")


def difficulty(value: Column) -> Column:
    own = F.lower(X.clean_text(value, 30))
    return F.when(own.isin(FOUNDATION), "foundation").when(own.isin(CHALLENGE), "challenge").otherwise("standard")


def preferred_difficulty(value: Column) -> Column:
    """The target that a difficulty preference asks for; null without one."""
    return F.when(value == "foundational", "foundation").when(value == "advanced", "challenge").when(value.isNotNull(), "standard")


def objective(text: Column) -> Column:
    """A learning objective that begins with a verb which can be checked."""
    return F.when(F.rlike(text, F.lit(OBJECTIVE_VERBS)), text).otherwise(F.concat(F.lit("能解释"), F.regexp_replace(text, "^(学会|理解|掌握)", "")))


def target_key(concept: Column, topic: Column, objective_: Column, new: Column) -> Column:
    """The key of a target: its concept, else topic, objective and news, in lower case."""
    whole = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (topic, objective_, new)])
    return F.lower(X.clean_text(F.coalesce(F.nullif(concept, F.lit("")), whole), 240))


def scope(category: Column, kind: Column, unit: Column, topic: Column) -> Column:
    """The key of what a preference is about: its category decides before the kind that was sent."""
    has_unit, has_topic = F.coalesce(unit, F.lit("")) != "", F.coalesce(topic, F.lit("")) != ""
    by_unit = has_unit & (category.isin(UNIT_CATEGORIES))
    by_topic = has_topic & category.isin(TOPIC_CATEGORIES)
    return (
        F.when(by_unit, F.concat(F.lit("unit:"), unit)).when(by_topic, F.concat(F.lit("topic:"), topic))
        .when((kind == "unit") & has_unit, F.concat(F.lit("unit:"), unit)).when((kind == "topic") & has_topic, F.concat(F.lit("topic:"), topic)).otherwise("global")
    )


#: Large columns that a list of documents leaves out.
PRIVATE = ["content", "text", "blocks"]


def filled(table: DataFrame, schema: dict) -> DataFrame:
    """table under a schema {column: (type, default)}: columns that it lacks and nulls get the default, others go."""
    default = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    own = set(table.columns)
    return table.select(*[(F.coalesce(F.col(c).cast(kind), default(v, kind)) if c in own else default(v, kind)).alias(c) for c, (kind, v) in schema.items()])


def public(documents: DataFrame) -> DataFrame:
    """Documents without their contents, which a columnar scan then leaves unread."""
    return documents.drop(*PRIVATE)


def manifest_faults(files: DataFrame, manifest: DataFrame, key: str, content: str) -> DataFrame:
    """(key, fault): files that manifest(key, sha256) doesn't list, lists twice or lists with another digest."""
    listed = manifest.groupBy(key).agg(F.count("*").alias("n"), F.first("sha256").alias("sha256"))
    told = files.select(key, F.sha2(content, 256).alias("own")).join(listed, key, "left")
    fault = F.when(F.col("n").isNull(), "unlisted").when(F.col("n") > 1, "listed_twice").when(F.col("own") != F.col("sha256"), "changed")
    return told.select(key, fault.alias("fault")).filter("fault IS NOT NULL")
