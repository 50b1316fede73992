"""Queries of the claim rules over cards about whole documents, and their SQL.

Sentences with two words of each document's own text are planted in its evidence and in the
fields of its card, one of a dozen by doc_id; the SQL works out each rule by brute force inside
every candidate.
"""

from __future__ import annotations

from lorecraft import bindings as B
from lorecraft.operators import claims as C
from lorecraft.plans.registry import Registry

query = Registry()

#: In SQL: the places (from 0) of all matches of a pattern, beside the matches.
_PLACES = """list_transform(range(len({found})), lambda i: list_sum(list_transform({gaps}[1:i + 1], lambda g: len(g))) + coalesce(list_sum(list_transform({found}[1:i], lambda q: len(q))), 0))"""

# ---- thresholds

_BOUND_SAID = [
    "若 {a} <= {b} 则通过。", "没有规则。", "要求 {a} < {b}。", "没有规则。", "没有规则。", "没有规则。", "没有规则。", "并非{a} 不超过 {b}。", "没有规则。", "规定 {b} 不小于 {a}。", "规定 {a}≤其{b}。",
    "没有规则。", "误以为 {a} <= {b}，实际 {b} >= {a}。",
]
_BOUND_FIELDS = {
    "card.summary": ([
        "因此 {b} >= {a}。", "因此 {a} <= {b}。", "因此 {a} ≤ {b}。", "不能认为{a} <= {b}。", "{a} 大于等于 {b}的说法是错误的。", None, None, None, "结论 {a} 不超过其zzqxv。", "先看{a}<={b}，再看 {b} <= {a}。", "即 {b}>={a}。",
        "“{a} <= {b}”不成立，但 {b} 小于等于 {a}。", "于是 {a} 不大于 {b}。",
    ], None, True),
    "exercise.answer": ([None, "{a} 不少于 {b}", "{b} >= {a}", "{a} 未超过 该 {b}", None, None, None, "{a} 不超过 {b}", None, "{a} <= {b}", None, None, None], None, False),
    "exercise.misconceptions.0": ([
        None, None, None, None, None, "{a} <= {b}：这个说法没有依据", "{a} <= {b}：其实 {b} <= {a}", None, "{a} <= {b}:同上", None, "{b} <= {a}：反了", None, None,
    ], [None, None, None, None, None, "{a} <= {b}", "{a} <= {b}", None, "{b} <= {a}", None, "{b} <= {a}", None, None], False),
}
_RELATION = r"\b([A-Za-z_][\w-]*)\s*(<=|>=|≤|≥|小于等于|大于等于|不超过|未超过|不大于|不少于|不小于)\s*(?:其|该)?\s*([A-Za-z_][\w-]*)\b"
_RELATIONS = f"""SELECT *, CASE WHEN sign IN ('>=', '≥', '大于等于', '不少于', '不小于') THEN r || '<=' || l ELSE l || '<=' || r END AS key FROM (
  SELECT id, pos, quote, regexp_extract(quote, '{_RELATION}', 1) AS l, regexp_extract(quote, '{_RELATION}', 2) AS sign, regexp_extract(quote, '{_RELATION}', 3) AS r,
    regexp_replace(regexp_extract(substr(body, 1, pos), '[^。；！？\\n]*$'), '[“‘"'']', '', 'g') AS before, regexp_replace(substr(body, pos + len(quote) + 1), '^[”’"'']', '') AS after
  FROM (SELECT id, body, unnest(found) AS quote, CAST(unnest({_PLACES.format(found="found", gaps="gaps")}) AS INTEGER) AS pos
    FROM (SELECT id, body, regexp_extract_all(body, '{_RELATION}', 0) AS found, string_split_regex(body, '{_RELATION}') AS gaps FROM {{}}))
) WHERE NOT regexp_matches(before, '(?:不是|并非|错误地认为|误以为|不能认为|不能推出|不能推导出|不能得出)\\s*$') AND NOT regexp_matches(after, '^(?:的(?:说法|规则|判断))?(?:是|并)?(?:错误|不成立|不准确)')"""
_QUOTED = "(option IS NOT NULL AND (starts_with(value, option || '：') OR starts_with(value, option || ':')))"


@query("QA5_boundaries", B.cards_sql(_BOUND_FIELDS, _BOUND_SAID) + f""", texts AS (SELECT candidate AS id, text AS body FROM evidence WHERE kind <> 'image'),
  supported AS (SELECT DISTINCT id, key FROM ({_RELATIONS.format("texts")})),
  named AS (SELECT DISTINCT id, unnest(string_split_regex(body, '[^A-Za-z0-9_-]+')) AS name FROM texts),
  f AS (SELECT *, candidate || '/' || field AS id FROM fields WHERE value IS NOT NULL),
  said AS MATERIALIZED ({_RELATIONS.format("(SELECT id, value AS body FROM f)")}),
  rest AS MATERIALIZED ({_RELATIONS.format(f"(SELECT id, substr(value, len(option) + 2) AS body FROM f WHERE {_QUOTED})")}),
  first AS (
    SELECT f.*, arg_min(said.quote, said.pos) AS quote FROM f JOIN said USING (id)
    WHERE EXISTS (FROM named n WHERE n.id = f.candidate AND n.name = said.l) AND EXISTS (FROM named n WHERE n.id = f.candidate AND n.name = said.r)
      AND NOT EXISTS (FROM supported s WHERE s.id = f.candidate AND s.key = said.key)
    GROUP BY ALL
  )
  SELECT candidate, field, quote FROM first WHERE NOT ({_QUOTED} AND instr(value, quote) - 1 < len(option)
    AND NOT EXISTS (FROM rest r WHERE r.id = first.id AND NOT EXISTS (FROM supported s WHERE s.id = first.candidate AND s.key = r.key)))""")
def qa5(spark, d):
    return C.boundary_issues(B.card_fields(spark, d, _BOUND_FIELDS), B.card_evidence(spark, d, _BOUND_SAID))


# ---- strengthened conditions

_HEDGED = [
    "缓存通常可以提升{a}速度。", "系统可能会丢失{a}。", "用户可以向{b}提交。", "缓存通常可以提升{a}速度，但总是提升{a}速度也有人说。", "用户可以使用{a}登录！", "系统可能丢失{a}；", "用户可以请求{a}。", "用户可以从{b}下载。",
    "用户可以提交{a}。", "系统可能会停止。也可能停止\n", "没有限定。", "缓存通常保留{a}。",
]
_STRONG_FIELDS = {
    "card.summary": ([
        "缓存总是提升{a}速度。", "系统一定会丢失{a}。", "用户必须提交。", "缓存总是提升{a}速度。", "用户不必须使用{a}登录，但应该使用{a}登录。", "并非一定丢失{a}。", "响应请求{a}。", "用户需要进行下载。", "用户应当提交{a}的说法错误。",
        "系统必然停止了。", "系统总是停止。", "缓存不能保留{a}",
    ], None, True),
    "exercise.answer": ([
        None, "一定丢失{a}", "应向{b}提交", "必须提升{a}速度", None, "“必定丢失{a}”不对；必定丢失{a}", "应请求{a}", "应该进行从{b}下载", "需要提交{a}吗", None, None, "通常不得保留{a}。",
    ], None, False),
    "exercise.misconceptions.1": ([
        "认为缓存必须提升{a}速度，其实不是", "必然丢失{a}：错了", "以为用户应提交，其实用户必须向{b}提交", None, "必须使用{a}登录：不是必须使用{a}登录", None, None, "需要下载：不一定", None, "必定停止: 一定停止", None, None,
    ], [None, "必然丢失{a}", None, None, "必须使用{a}登录", None, None, "应当下载", None, "必定停止", None, None], False),
}
_HEDGES = "(通常(?:可以|可)?|可以|可能会|可能)([^，。；！？\\n]{2,40})([，。；！？\\n]|$)"
_SHORT = "^(?:向|对|给|从|在|通过|使用|用)[\\x{4e00}-\\x{9fff}A-Za-z0-9_-]{1,12}([\\x{4e00}-\\x{9fff}]{2})$"


@query("QA6_conditions", B.cards_sql(_STRONG_FIELDS, _HEDGED) + f""", hedged AS (
    SELECT candidate, source, pos, regexp_extract(found, '{_HEDGES}', 1) AS hedge, regexp_extract(found, '{_HEDGES}', 2) AS action
    FROM (SELECT candidate, source, unnest(regexp_extract_all(text, '{_HEDGES}')) AS found, unnest(range(len(regexp_extract_all(text, '{_HEDGES}')))) AS pos FROM evidence)
  ), forms AS (
    SELECT *, regexp_extract(action, '{_SHORT}', 1) AS short, regexp_replace(action, '^(?:向|对|给|从|在)', '') AS bare,
      CASE WHEN starts_with(hedge, '通常') THEN ['总是', '必须', '不能', '不得', '不允许'] WHEN hedge = '可以' THEN ['需要', '必须', '应该', '应当', '应'] ELSE ['一定', '一定会', '必然', '必然会', '必定', '必定会'] END AS words
    FROM hedged
  ), said AS (
    SELECT *, list_filter([action, CASE WHEN short <> '' THEN short END, CASE WHEN short <> '' AND bare <> action THEN bare END, CASE WHEN short <> '' AND bare <> action THEN '进行' || bare END,
      CASE WHEN short <> '' AND bare <> action THEN '进行' || short END], lambda x: x IS NOT NULL) AS shapes FROM forms
  ), w AS (SELECT *, unnest(words) AS word, unnest(range(len(words))) AS wi FROM said),
  s AS (SELECT *, word || form AS statement FROM (SELECT *, unnest(shapes) AS form, unnest(range(len(shapes))) AS fi FROM w)),
  loose AS (SELECT * FROM s WHERE NOT EXISTS (FROM evidence e WHERE e.candidate = s.candidate AND (contains(e.text, s.statement) OR contains(e.text, s.word || s.action)))),
  p AS (
    SELECT l.*, f.field, f.value, f.option, unnest(list_filter(range(len(f.value)), lambda i: substr(f.value, i + 1, len(l.statement)) = l.statement)) AS place
    FROM loose l JOIN fields f ON f.candidate = l.candidate AND contains(f.value, l.statement)
  ), windows AS (
    SELECT *, regexp_replace(substr(value, greatest(place - 15, 1), least(place, 16)), '[“‘「"'']', '', 'g') AS before, regexp_extract(substr(value, place + len(statement) + 1), '^[^，。；！？\\n]*') AS after,
      regexp_replace(trim(regexp_extract(substr(value, 1, place), '[^，。；！？\\n]*$')), '[“‘「"'']', '', 'g') AS clause, substr(value, place + len(statement) + 1, 1) AS next, field LIKE 'exercise.misconceptions.%' AS misread
    FROM p
  ), good AS (
    SELECT * FROM windows WHERE NOT regexp_matches(before, '(?:不|并非|不是|不代表|不意味着|不能认为|不能说|不要说|没有说明|不必|无需)$') AND NOT regexp_matches(before, '(?:误以为|误认为|错误地认为)[^，。；！？\\n]{{0,12}}$')
      AND NOT regexp_matches(after, '^[”’」"'']?(?:的(?:说法|观点))?(?:是|并)?(?:错误|不对|不成立|不准确)') AND NOT (misread AND regexp_matches(clause, '^(?:认为|以为)[^，。；！？\\n]{{0,24}}$'))
      AND NOT (misread AND {_QUOTED} AND place < len(option)) AND (form = action OR next = '' OR regexp_matches(next, '[，。；！？、：\\s”’」"'']'))
      AND (word <> '应' OR place = 0 OR NOT regexp_matches(substr(value, place, 1), '[响回反对适供感呼接顺相照因报效答支酬兑]'))
  ), first AS (SELECT *, row_number() OVER (PARTITION BY candidate, field ORDER BY source, pos, wi, fi) AS n FROM good)
  SELECT candidate, field, hedge || action AS phrase, statement, starts_with(hedge, '通常') AND word IN ('不能', '不得', '不允许') AND starts_with(field, 'exercise.') AS new_question,
    CASE WHEN form = action THEN 'literal' ELSE 'omitted_modifier' END AS kind FROM first WHERE n = 1""")
def qa6(spark, d):
    return C.strengthened_conditions(B.card_fields(spark, d, _STRONG_FIELDS), B.card_evidence(spark, d, _HEDGED))


# ---- claims about images

_CAPTION = ["图中有{a}。", "图注：{b}已修改。", "通常如此。", "原始数据在左。", "磁盘为空。", "没有图注。", "没有图注。", "没有图注。", "没有图注。", "没有图注。", "usually {a}", "没有图注。"]
_SEEN = ["标签“{a}”", "白色矩形", "标签“{a}”", "左侧方框", "矩形", "正在写入", "标签“{b}”", "矩形", "标签“{b}”", None, "矩形", "矩形"]
_LEGEND = [None, None, None, None, None, None, None, "有数据", None, "总是", None, None]
_IMAGE_FIELDS = {
    "card.summary": ([
        "白框表示内存为空。", "{a}已修改，{b}未修改。", "{a}总是在左。", "保持原样的页在左。", "白框说明磁盘中有内容。", "{a}正在写入，{b}被写入。", "不能由此得出{a}通常在左，但一般为{b}。", "意味着磁盘有数据，而{a}已提交。", "没有说明{a}尚未提交，也没有依据说原数据在此；保留区在右。",
        "一般来说{a}在左，原始页在右。", "{a}始终在左。", "从来{a}在左的说法不成立。通常{b}在右。",
    ], None, True),
    "exercise.answer": (["{a}", "提交后{a}", "一般会{b}", "原始内容", None, "写入", "总是{a}这一推断无依据", None, "回滚", "永远", "提交时", None], None, False),
}
_STATES = "(?:原始(?:数据|内容|页)|原数据|保持原样|(?:已|未|尚未|被|正在)?(?:修改|写入|回滚)|(?:已|未|尚未)提交|提交[后时]|保留区)"
_GENERAL = "(?:通常|一般来说|一般情况下|一般而言|一般(?:为|是|会|都|有|没|不|可以)|总是|始终|从来|永远)"
_FOUND = """SELECT candidate, field, value, unnest(found) AS quote, CAST(unnest({places}) AS INTEGER) AS pos FROM (
    SELECT candidate, field, value, regexp_extract_all(value, '{pattern}', 0) AS found, string_split_regex(value, '{pattern}') AS gaps FROM f)"""


@query("QA17_image_claims", B.cards_sql(_IMAGE_FIELDS, _CAPTION, _SEEN, _LEGEND) + f""", known AS (
    SELECT candidate, bool_or(kind = 'image' AND observations IS NOT NULL) AS image, string_agg(CASE WHEN kind = 'image' THEN array_to_string(coalesce(observations, []) || coalesce(legend, []), chr(10)) ELSE coalesce(text, '') END, chr(10)) AS support,
      string_agg(CASE WHEN kind = 'text' THEN text END, chr(10)) AS captions, string_agg(CASE WHEN kind = 'image' THEN array_to_string(coalesce(legend, []), chr(10)) ELSE text END, chr(10)) AS written
    FROM evidence GROUP BY candidate
  ), f AS (SELECT fields.* FROM fields JOIN known USING (candidate) WHERE image AND value IS NOT NULL),
  content AS (SELECT candidate, field, regexp_extract(value, '(?:表示|说明|意味着)[^，。；\\n]{{0,12}}(?:系统缓冲区|用户内存|数据库|磁盘|内存)(?:中|内)?(?:为空|有内容|没有内容|有数据|没有数据)') AS quote FROM f),
  general AS ({_FOUND.format(places=_PLACES.format(found="found", gaps="gaps"), pattern=_GENERAL)}),
  general_left AS (
    SELECT *, row_number() OVER (PARTITION BY candidate, field ORDER BY pos) AS n FROM general
    WHERE NOT regexp_matches(regexp_extract(substr(value, 1, pos), '[^，,。；;！？\\n]*$'), '(?:不能|无法|不足以|未能|没有依据|没有说明|不代表|不意味着|并非|不是)[^，,。；;！？\\n]{{0,24}}$')
      AND NOT regexp_matches(substr(value, pos + len(quote) + 1), '^[^，,。；;！？\\n]{{0,30}}(?:说法|结论|推断)[^，,。；;！？\\n]{{0,4}}(?:不成立|无依据|错误)')
  ), state AS ({_FOUND.format(places=_PLACES.format(found="found", gaps="gaps"), pattern=_STATES)}),
  state_left AS (
    SELECT candidate, field, quote, row_number() OVER (PARTITION BY candidate, field ORDER BY pos) AS n FROM state JOIN known USING (candidate)
    WHERE NOT contains(support, quote) AND NOT (regexp_matches(quote, '修改|写入|回滚|提交') AND contains(captions, regexp_extract(quote, '修改|写入|回滚|提交')))
      AND NOT (regexp_matches(quote, '原始|原数据|保持原样') AND regexp_matches(captions, '原始(?:数据|内容|页)|原数据|保持原样'))
      AND NOT regexp_matches(regexp_extract(substr(value, 1, pos), '[^，。；！？\\n]*$'), '(?:不能|无法|不足以|未能|没有依据|没有说明|并不代表)[^，。；！？\\n]{{0,24}}$')
  )
  SELECT candidate, field, 'image_claim_unverified' AS code, quote FROM content JOIN known USING (candidate) WHERE quote <> '' AND NOT regexp_matches(written, '为空|有内容|没有内容|有数据|没有数据')
  UNION ALL SELECT candidate, field, 'image_scope_unverified', CASE WHEN starts_with(quote, '一般') AND NOT regexp_matches(quote, '一般(?:来说|情况下|而言)') THEN '一般' ELSE quote END
    FROM general_left JOIN known USING (candidate) WHERE n = 1 AND NOT regexp_matches(support, '(?i)通常|一般|总是|始终|从来|永远|\\b(?:usually|generally|typically|normally|always|never)\\b')
  UNION ALL SELECT candidate, field, 'image_claim_unverified', quote FROM state_left WHERE n = 1""")
def qa17(spark, d):
    return C.image_issues(B.card_fields(spark, d, _IMAGE_FIELDS), B.card_evidence(spark, d, _CAPTION, _SEEN, _LEGEND))
