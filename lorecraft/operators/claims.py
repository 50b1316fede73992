"""What the fields of a card claim beyond its evidence: thresholds, strengthened conditions, claims about images.

fields(candidate, field, value, option) has a row for each text of a card and its exercise, with
the answer option that a misconception belongs to; evidence(candidate, source, kind, text,
observations, legend) has a row for each source. Each text is read once, where it lies: what a
rule needs of it becomes short keys (normalised relations, a word and what follows it, flags),
and only these meet, by equi-joins inside a candidate. No text is set against another text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.functions import text as X

# Patterns and words of the claim rules.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # a word boundary of ASCII letters
# no sign begins with what a name or white space may hold, so neither gives anything back
RELATION = r"(?<!\w)([A-Za-z_][\w-]*+)\s*+(<=|>=|≤|≥|小于等于|大于等于|不超过|未超过|不大于|不少于|不小于)\s*(?:其|该)?\s*([A-Za-z_][\w-]*)" + _EDGE
REVERSED = [">=", "≥", "大于等于", "不少于", "不小于"]
RELATION_DENIED = r"(?:不是|并非|错误地认为|误以为|不能认为|不能推出|不能推导出|不能得出)\s*$"
RELATION_REJECTED = r"^(?:的(?:说法|规则|判断))?(?:是|并)?(?:错误|不成立|不准确)"
HEDGE = r"(通常(?:可以|可)?|可以|可能会|可能)([^，。；！？\n]{2,40})(?=[，。；！？\n]|$)"
STRONGER = {"通常": ["总是", "必须", "不能", "不得", "不允许"], "可以": ["需要", "必须", "应该", "应当", "应"], "可能": ["一定", "一定会", "必然", "必然会", "必定", "必定会"]}
SHORTENED = r"^(?:向|对|给|从|在|通过|使用|用)[\x{4e00}-\x{9fff}A-Za-z0-9_-]{1,12}([\x{4e00}-\x{9fff}]{2})$"
PREPOSITION, CARRY_OUT = "^(?:向|对|给|从|在)", "进行"
STRONG = "总是|必须|不能|不得|不允许|需要|应|一定|必然|必定"
LONGER = {"应": ["该", "当"], "一定": ["会"], "必然": ["会"], "必定": ["会"]}
STRENGTH_DENIED = r"(?:不|并非|不是|不代表|不意味着|不能认为|不能说|不要说|没有说明|不必|无需)$|(?:误以为|误认为|错误地认为)[^，。；！？\n]{0,12}$"
STRENGTH_REJECTED = r"^[”’」\"']?(?:的(?:说法|观点))?(?:是|并)?(?:错误|不对|不成立|不准确)"
BELIEF = r"^(?:认为|以为)[^，。；！？\n]{0,24}$"
COMPLETE = r"^(?:$|[，。；！？、：\s\p{Z}”’」\"'])"
ANSWERING = "[响回反对适供感呼接顺相照因报效答支酬兑]$"
CONTENT_CLAIM = r"(?:表示|说明|意味着)[^，。；\n]{0,12}(?:系统缓冲区|用户内存|数据库|磁盘|内存)(?:中|内)?(?:为空|有内容|没有内容|有数据|没有数据)"
CONTENT_STATES = "为空|有内容|没有内容|有数据|没有数据"
GENERAL = r"通常|一般(?:来说|情况下|而言|(?=为|是|会|都|有|没|不|可以))|总是|始终|从来|永远"
GENERAL_SUPPORT = r"(?i)通常|一般|总是|始终|从来|永远|(?<!\w)(?:usually|generally|typically|normally|always|never)(?!\w)"
GENERAL_DENIED = r"(?:不能|无法|不足以|未能|没有依据|没有说明|不代表|不意味着|并非|不是)[^，,。；;！？\n]{0,24}$"
GENERAL_REJECTED = r"^[^，,。；;！？\n]{0,30}(?:说法|结论|推断)[^，,。；;！？\n]{0,4}(?:不成立|无依据|错误)"
STATE = r"原始(?:数据|内容|页)|原数据|保持原样|(?:已|未|尚未|被|正在)?(?:修改|写入|回滚)|(?:已|未|尚未)提交|提交[后时]|保留区"
STATE_WORDS = ["修改", "写入", "回滚", "提交"]
ORIGINAL, ORIGINAL_CAPTION = "原始|原数据|保持原样", "原始(?:数据|内容|页)|原数据|保持原样"
STATE_DENIED = r"(?:不能|无法|不足以|未能|没有依据|没有说明|并不代表)[^，。；！？\n]{0,24}$"

#: Characters of a statement after its strong word, and those after it that a rule looks at.
_FORM, _AFTER = 44, 12


def last_clause(text: Column, breaks: str) -> Column:
    # a split reads the text once; a search for a run that ends it would begin at every place
    return F.element_at(F.split(text, f"[{breaks}]"), -1)


def has_text(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"\S")), F.lit(False))


def one_each(rows: DataFrame, items: Column, name: str, *columns) -> DataFrame:
    """columns of rows with a row for each item of an array.

    Spark infers no filter on the array of an outer explode, which would work out its expression again.
    """
    return rows.select(*columns, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def texts_of(evidence: DataFrame) -> DataFrame:
    """The sources of evidence that are texts, blank ones left out."""
    return evidence.filter((F.coalesce("kind", F.lit("text")) != "image") & has_text(F.col("text")))


# ---- thresholds


def relations(text: Column) -> Column:
    """Inclusive comparisons of two names that a text states: array of (left, right, key, quote, at).

    Turned comparisons have the key of the other direction. What is denied before or rejected
    after a comparison isn't stated. Every match is tried.
    """

    def told(text: Column, m: Column) -> Column:
        before = F.regexp_replace(last_clause(X.head(text, m["at"]), r"。；！？\n"), "[“‘\"']", "")
        after = F.regexp_replace(X.tail(text, m["at"] + F.length(m["quote"])), "^[”’\"']", "")
        left, sign, right = (F.regexp_extract(m["quote"], RELATION, i) for i in (1, 2, 3))
        key = F.when(sign.isin(REVERSED), F.concat(right, F.lit("<="), left)).otherwise(F.concat(left, F.lit("<="), right))
        stated = ~F.rlike(before, F.lit(RELATION_DENIED)) & ~F.rlike(after, F.lit(RELATION_REJECTED))
        return F.struct(left.alias("left"), right.alias("right"), key.alias("key"), m["quote"].alias("quote"), m["at"].alias("at"), stated.alias("stated"))

    # the text is worked out once, however many matches read it
    return X.let(text, lambda t: F.filter(F.transform(X.matches(t, RELATION), lambda m: told(t, m)), lambda r: r["stated"]))


def boundary_issues(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """(candidate, field, quote): the first comparison of each field between names of the evidence that no source states.

    A misconception may quote its option first; it is then left out, unless what follows claims
    an unsupported comparison too. Null and blank texts claim and support nothing; repeated rows
    of a field are one field. An empty table gives an empty table.
    """
    texts = texts_of(evidence)
    supported = one_each(texts, relations(F.col("text")), "r", "candidate").select("candidate", F.col("r.key").alias("key")).distinct().withColumn("supported", F.lit(True))
    quoted = F.coalesce(has_text(F.col("option")) & (F.startswith("value", F.concat("option", F.lit("："))) | F.startswith("value", F.concat("option", F.lit(":")))), F.lit(False))
    marked = lambda r, rest: F.struct(r["left"].alias("left"), r["right"].alias("right"), r["key"].alias("key"), r["quote"].alias("quote"), r["at"].alias("at"), F.lit(rest).alias("rest"))
    own = F.transform(relations(F.col("value")), lambda r: marked(r, False))
    rest = F.transform(F.filter(relations(X.tail(F.col("value"), F.length("option") + 1)), lambda r: F.col("quoted")), lambda r: marked(r, True))
    told = fields.filter(has_text(F.col("value"))).withColumn("quoted", quoted)
    none = F.array().cast("array<struct<left:string,right:string,key:string,quote:string,at:int,rest:boolean>>")
    told = one_each(told, F.concat(own, F.coalesce(rest, none)), "r", "candidate", "field", "value", "option", "quoted")
    covered = F.col("quoted") & (F.instr(F.col("value"), F.col("r.quote")) - 1 < F.length("option"))
    entries = told.select("candidate", "field", "r.*", F.coalesce(covered, F.lit(False)).alias("covered"))
    names = entries.filter(~F.col("rest")).select("candidate", F.explode(F.array("left", "right")).alias("name")).groupBy("candidate").agg(F.collect_set("name").alias("names"))
    # a text meets the few names of its candidate; its words are no rows
    words = one_each(texts.join(names, "candidate"), F.array_intersect(F.split("text", "[^A-Za-z0-9_-]+"), "names"), "name", "candidate")
    known = words.distinct().withColumn("known", F.lit(True))
    of = lambda side: known.select("candidate", F.col("name").alias(side), F.col("known").alias(f"{side}_known"))
    flagged = entries.join(supported, ["candidate", "key"], "left").join(of("left"), ["candidate", "left"], "left").join(of("right"), ["candidate", "right"], "left")
    open_ = F.col("supported").isNull()
    first = F.min(F.when(~F.col("rest") & open_ & F.col("left_known") & F.col("right_known"), F.struct("at", "quote", "covered")))
    out = flagged.groupBy("candidate", "field").agg(first.alias("first"), F.bool_or(F.col("rest") & open_).alias("rest_open"))
    return out.filter(F.col("first").isNotNull() & ~(F.col("first.covered") & ~F.col("rest_open"))).select("candidate", "field", F.col("first.quote").alias("quote"))


# ---- strengthened conditions


def strong_places(text: Column) -> Column:
    """Every strengthening word of a text, array of (word, at, form): the longer ones too, each with what follows it."""

    def words(text: Column, m: Column) -> Column:
        more = [F.when(m["quote"] == base, F.concat(F.lit(base), F.lit(end))) for base, ends in LONGER.items() for end in ends]
        follows = lambda w: F.startswith(X.tail(text, m["at"]), w)
        own = F.filter(F.array_compact(F.array(m["quote"], *more)), follows)
        return F.transform(own, lambda w: F.struct(w.alias("word"), m["at"].alias("at"), F.substring(text, m["at"] + F.length(w) + 1, F.lit(_FORM + _AFTER)).alias("form")))

    return X.let(text, lambda t: F.flatten(F.transform(X.matches(t, STRONG), lambda m: words(t, m))))


def statements(text: Column) -> Column:
    """What would strengthen the hedged phrases of a text: array of (phrase, hedge, action, word, form, at, word_place, form_place)."""

    def of(m: Column) -> Column:
        hedge, action = F.regexp_extract(m["quote"], HEDGE, 1), F.regexp_extract(m["quote"], HEDGE, 2)
        words = F.when(F.startswith(hedge, F.lit("通常")), F.array(*map(F.lit, STRONGER["通常"]))).when(hedge == "可以", F.array(*map(F.lit, STRONGER["可以"]))).otherwise(F.array(*map(F.lit, STRONGER["可能"])))
        short, bare = F.regexp_extract(action, SHORTENED, 1), F.regexp_replace(action, PREPOSITION, "")
        more = [short, *[F.when(bare != action, c) for c in (bare, F.concat(F.lit(CARRY_OUT), bare), F.concat(F.lit(CARRY_OUT), short))]]
        forms = F.array_compact(F.when(short != "", F.array(action, *more)).otherwise(F.array(action)))
        one = lambda w, i, f, j: F.struct(m["quote"].alias("phrase"), hedge.alias("hedge"), action.alias("action"), w.alias("word"), f.alias("form"), m["at"].alias("at"), i.alias("word_place"), j.alias("form_place"))
        return F.flatten(F.transform(words, lambda w, i: F.transform(forms, lambda f, j: one(w, i, f, j))))

    return F.flatten(F.transform(X.matches(text, HEDGE), of))


def anchored(rows: DataFrame, form: str) -> DataFrame:
    """rows with anchor: the first two characters of a form, of which every form has that many."""
    return rows.withColumn("anchor", F.substring(form, 1, 2))


def strengthened_conditions(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """(candidate, field, phrase, statement, new_question, kind): the first hedged phrase of the evidence that each field makes a rule.

    A hedged phrase of a source, said with a stronger word, is a statement; so are its forms
    without the preposition. A statement counts where no source makes it or the unshortened one
    itself, and a field says it undenied, outside a quoted option or a reported belief, as a
    whole action. Sources come in the order of source, phrases by place. Statements meet fields
    and sources by candidate, strong word and the first two characters after it.

    Null and blank texts claim nothing; repeated rows of a field are one field. A statement that
    overlaps itself is looked for at every place. An empty table gives an empty table.
    """
    texts = texts_of(evidence)
    hedged = texts.select("candidate", "source", F.explode(statements(F.col("text"))).alias("s")).select("candidate", "source", "s.*")
    keys = ["candidate", "word", "anchor"]
    wanted = hedged.select("candidate", "word", "form").unionByName(hedged.select("candidate", "word", F.col("action").alias("form"))).distinct()
    said = anchored(texts.select("candidate", F.explode(strong_places(F.col("text"))).alias("p")).select("candidate", "p.word", F.substring("p.form", 1, _FORM).alias("said")).distinct(), "said")
    backed = anchored(wanted, "form").join(said, keys).filter(F.startswith("said", F.col("form"))).select("candidate", "word", "form").distinct()
    loose = hedged.join(backed, ["candidate", "word", "form"], "left_anti").join(backed.withColumnRenamed("form", "action"), ["candidate", "word", "action"], "left_anti")

    misread = F.startswith("field", F.lit("exercise.misconceptions."))
    told = fields.filter(has_text(F.col("value"))).select("candidate", "field", "value", "option", F.explode(strong_places(F.col("value"))).alias("p"))
    at, value = F.col("p.at"), F.col("value")
    bare = lambda c: F.regexp_replace(c, "[“‘「\"']", "")
    before = bare(F.substring(value, F.greatest(at - 15, F.lit(1)), F.least(at, F.lit(16))))
    belief = misread & F.rlike(bare(F.trim(last_clause(X.head(value, at), r"，。；！？\n"))), F.lit(BELIEF))
    quoted = misread & has_text(F.col("option")) & (F.startswith(value, F.concat("option", F.lit("："))) | F.startswith(value, F.concat("option", F.lit(":")))) & (at < F.length("option"))
    answering = (F.col("p.word") == "应") & F.rlike(X.head(value, at), F.lit(ANSWERING))
    denied = F.rlike(before, F.lit(STRENGTH_DENIED)) | F.coalesce(belief, F.lit(False)) | F.coalesce(quoted, F.lit(False)) | answering
    claims = anchored(told.filter(~denied).select("candidate", "field", F.col("p.word").alias("word"), at.alias("place"), F.col("p.form").alias("said")), "said")

    met = anchored(loose, "form").join(claims, keys).filter(F.startswith("said", F.col("form")))
    after = F.substring(F.col("said"), F.length("form") + 1, F.lit(_AFTER))
    rejected = F.rlike(F.regexp_extract(after, r"^[^，。；！？\n]*", 0), F.lit(STRENGTH_REJECTED))
    whole = (F.col("form") == F.col("action")) | F.rlike(after, F.lit(COMPLETE))
    order = ["source", "at", "word_place", "form_place"]
    first = F.min(F.struct(*order, "phrase", "hedge", "word", "form", "action")).alias("f")
    out = met.filter(~rejected & whole).groupBy("candidate", "field").agg(first)
    forbids = F.startswith("f.hedge", F.lit("通常")) & F.col("f.word").isin("不能", "不得", "不允许") & F.startswith("field", F.lit("exercise."))
    kind = F.when(F.col("f.form") == F.col("f.action"), "literal").otherwise("omitted_modifier")
    return out.select("candidate", "field", F.col("f.phrase").alias("phrase"), F.concat("f.word", "f.form").alias("statement"), forbids.alias("new_question"), kind.alias("kind"))


# ---- claims about images


def image_issues(fields: DataFrame, evidence: DataFrame) -> DataFrame:
    """(candidate, field, code, quote): what a card with images claims beyond what is seen in them or written beside them.

    image_claim_unverified for contents that a shape can't show and for states that neither an
    observation nor a caption names; image_scope_unverified where one image becomes a general
    rule. Each source becomes flags and the few state words in it, each candidate one row of
    them; fields meet that row. Every match of a field is tried until one is unsupported.

    Candidates without an image that has observations have no issues, whatever the other columns
    hold. Null and blank fields claim nothing. An empty table gives an empty table.
    """
    is_image = F.coalesce("kind", F.lit("text")) == "image"
    seen = F.array_join(F.concat(F.coalesce("observations", F.array().cast("array<string>")), F.coalesce("legend", F.array().cast("array<string>"))), "\n")
    legend = F.array_join(F.coalesce("legend", F.array().cast("array<string>")), "\n")
    support = F.when(is_image, seen).otherwise(F.coalesce("text", F.lit("")))
    caption = F.when(is_image, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    states = F.array_distinct(F.flatten(F.transform(F.array(*[F.lit(w) for w in state_names()]), lambda w: F.when(F.contains(support, w), F.array(w)).otherwise(F.array().cast("array<string>")))))
    roots = F.array_compact(F.array(*[F.when(F.contains(caption, F.lit(w)), w) for w in STATE_WORDS]))
    flags = evidence.select(
        "candidate", (is_image & F.col("observations").isNotNull()).alias("image"), F.rlike(F.when(is_image, legend).otherwise(caption), F.lit(CONTENT_STATES)).alias("content"),
        F.rlike(support, F.lit(GENERAL_SUPPORT)).alias("general"), states.alias("states"), roots.alias("roots"), F.rlike(caption, F.lit(ORIGINAL_CAPTION)).alias("original"),
    )
    # the words are from fixed lists, so the sets are small
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    words = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    known = flags.groupBy("candidate").agg(*[any_(c) for c in ("image", "content", "general", "original")], words("states"), words("roots")).filter("image")
    both = fields.filter(has_text(F.col("value"))).select("candidate", "field", "value").dropDuplicates(["candidate", "field"]).join(known, "candidate")
    value = F.col("value")
    before = lambda m, breaks: last_clause(X.head(value, m["at"]), breaks)

    content = F.get(F.regexp_extract_all(value, F.lit(CONTENT_CLAIM), F.lit(0)), 0)
    broad = F.filter(X.matches(value, GENERAL), lambda m: ~F.rlike(before(m, r"，,。；;！？\n"), F.lit(GENERAL_DENIED)) & ~F.rlike(X.tail(value, m["at"] + F.length(m["quote"])), F.lit(GENERAL_REJECTED)))

    def loose(m: Column) -> Column:
        root = F.get(F.regexp_extract_all(m["quote"], F.lit("|".join(STATE_WORDS)), F.lit(0)), 0)
        backed = F.array_contains("states", m["quote"]) | F.coalesce(F.array_contains("roots", root), F.lit(False)) | (F.rlike(m["quote"], F.lit(ORIGINAL)) & F.col("original"))
        return ~backed & ~F.rlike(before(m, r"，。；！？\n"), F.lit(STATE_DENIED))

    state = F.filter(X.matches(value, STATE), loose)
    issue = lambda code, quote, when: F.when(when & quote.isNotNull(), F.struct(F.lit(code).alias("code"), quote.alias("quote")))
    found = F.array_compact(F.array(
        issue("image_claim_unverified", content, ~F.col("content")), issue("image_scope_unverified", F.get(broad, 0)["quote"], ~F.col("general")), issue("image_claim_unverified", F.get(state, 0)["quote"], F.lit(True)),
    ))
    return both.select("candidate", "field", F.explode(found).alias("i")).select("candidate", "field", "i.code", "i.quote")


def state_names() -> list[str]:
    """Every word that the pattern of states can match."""
    marks = ["", "已", "未", "尚未", "被", "正在"]
    return ["原始数据", "原始内容", "原始页", "原数据", "保持原样", *[m + w for w in STATE_WORDS[:3] for m in marks], "已提交", "未提交", "尚未提交", "提交后", "提交时", "保留区"]
