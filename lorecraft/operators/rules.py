"""Card rules on single sentences, outlines, sources and references, as column expressions and joins.

A rule looks at each field of an exploded field table (key, field, value) clause by clause: one
pass over the rows, no shuffle but for what a rule needs of another table.
"""

from __future__ import annotations

import html.parser
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.functions import text as X
from lorecraft.operators import discovery as D

# Patterns of the card rules.
RETURNED = r"返回(?:值)?(?:为|是|：|:)?\s*([+-]?\d+(?:\.\d+)?)(?![\d.])"
NOT_RETURNED = r"(?:不是|而非|不应|并非|错误地)\s*$"
REPEATED_CALL = r"第[一二三四五六七八九十\d]+次[\s\S]*返回|连续调用[\s\S]*返回"
STABLE, SORTING = "稳定|stable", "排序|sort"
LEAK, LEAK_ASKS, LEAK_OK = r"先按次要键[^。\n]{0,14}再按主要键", "什么顺序|什么次序", "是否|错误|纠正"
ORDER = r"先按([^，。；\s]{1,14}?)排序[^。\n]*?再按([^，。；\s]{1,14}?)排序"
PRIORITY = "主要|次要|主键|次键|优先"
FIXED_DISTANCE = r"(?:同一|固定)(?:构图[与和、])?(?:对焦距离|拍摄距离|物距)|保持(?:对焦距离|拍摄距离|物距)不变"
MOVED = r"(?:缩短|增加|增大|减小|改变|调整)[^，。；]{0,6}(?:对焦距离|拍摄距离|物距)|(?:更近|更远)(?:的)?拍摄距离|(?:相机|镜头)[^，。；]{0,12}(?:更近|更远|靠近|远离)"
NEGATED_BEFORE = r"(?:不能|不可|不应|不允许|不要|避免|并非|不|错误地认为)[^，,]{0,10}$"
NEGATED_AFTER = r"^(?:的(?:说法|做法|结论))?(?:会|将|就|是|则)?(?:违反|破坏|错误|不成立|不满足|无法保持)"
LIMIT_THEOREM = r"(?i)中心极限定理|(?<!\w)CLT(?!\w)"
ACCURACY = r"(?i)Berry[ -]?Esseen|误差(?:上界|不超过|小于|≤)|假定[^。\n]{0,25}(?:近似|样本量足够)|(?:原始分布|总体|随机变量)(?:本身)?(?:是|为|服从)正态分布"
ENOUGH = r"(?i)(?:(?<!\w)n|样本量|样本数|样本大小)\s*(?:为|是|=|＝)\s*\d+\s*(?:已|已经|就|便|通常)?(?:足够大|够大|足以)"
OTHERS_SEE = r"(?:另一|其他|其它)(?:个)?事务[^。；]{0,24}(?:看不到|看到|看见|可见)"
SEE_OK = "不能|无法|未说明|没有说明|不保证|是否|假设|假定"
SENSITIVITY = r"(?:检测)?准确率\s*[（(]\s*灵敏度\s*[）)]|灵敏度\s*(?:就是|即|等同于)\s*(?:检测)?准确率"
TERM_BEFORE, TERM_AFTER = r"不能(?:说|认为)|错误(?:地认为|说法)|误以为|不要(?:写|说)|并非", r"^(?:的(?:说法|写法|表述))?(?:是)?(?:错误|不准确|不严谨)"
GO_ON = r"其他(?:已经|已)?(?:启动的)?任务(?:仍然|仍|还|将|会)*继续(?:执行|运行)"
GO_ON_BEFORE, GO_ON_AFTER = "尚未完成|还未完成|未完成|未结束|不意味着|不代表|不能认为|不能说", "(?:说法|结论).{0,6}(?:不成立|错误)"


def clauses(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"[。；\n]")


def clause_says(text: Column, pattern: str, before: str | None = None, after: str | None = None, every: bool = True) -> Column:
    """Whether a match of the pattern in a clause isn't taken back by what stands before or after it in the clause: any match, or only each clause's first."""
    def stands(c: Column, m: Column) -> Column:
        good = F.lit(True)
        if before:
            good = good & ~F.rlike(X.head(c, m["at"]), F.lit(before))
        if after:
            good = good & ~F.rlike(X.tail(c, m["at"] + F.length(m["quote"])), F.lit(after))
        return good

    found = lambda c: X.matches(c, pattern) if every else F.slice(X.matches(c, pattern), 1, 1)
    return F.exists(clauses(text), lambda c: F.exists(found(c), lambda m: stands(c, m)))


def last_returned(text: Column) -> Column:
    """The last number that a text says is returned, those that it denies left out."""
    said = F.filter(X.matches(text, RETURNED), lambda m: ~F.rlike(X.head(text, m["at"]), F.lit(NOT_RETURNED)))
    return F.regexp_extract(F.try_element_at(said, F.lit(-1))["quote"], RETURNED, 1).try_cast("double")


def numeric_mismatch(question: Column, answer: Column, explanation: Column) -> Column:
    """Whether answer and explanation of a repeated call return different numbers last."""
    return F.coalesce(F.rlike(question, F.lit(REPEATED_CALL)) & (last_returned(answer) != last_returned(explanation)), F.lit(False))


def sorting_issue(source: Column, question: Column, answer: Column) -> Column:
    """exercise_answer_leak where the question gives the order it asks for; sorting_priority_ambiguous where it is the reverse of the answer's."""
    about = F.rlike(source, F.lit(STABLE)) & F.rlike(source, F.lit(SORTING))
    leak = F.rlike(question, F.lit(LEAK)) & F.rlike(question, F.lit(LEAK_ASKS)) & ~F.rlike(question, F.lit(LEAK_OK))
    part = lambda c, i: F.regexp_extract(c, ORDER, i)
    turned = (part(question, 1) != "") & (part(question, 1) == part(answer, 2)) & (part(question, 2) == part(answer, 1)) & ~F.rlike(question, F.lit(PRIORITY))
    return F.when(about & leak, "exercise_answer_leak").when(about & turned, "sorting_priority_ambiguous")


def condition_issue(source: Column, question: Column, value: Column) -> Column:
    """question_condition_conflict where an answer moves what the question fixes; finite_sample_unverified where a count alone is called enough."""
    moved = F.contains(source, F.lit("景深")) & F.rlike(question, F.lit(FIXED_DISTANCE)) & clause_says(value, MOVED, NEGATED_BEFORE, NEGATED_AFTER)
    few = F.rlike(source, F.lit(LIMIT_THEOREM)) & ~F.rlike(F.concat_ws("\n", source, question), F.lit(ACCURACY)) & clause_says(value, ENOUGH, NEGATED_BEFORE, NEGATED_AFTER, every=False)
    return F.when(moved, "question_condition_conflict").when(few, "finite_sample_unverified")


def transaction_issue(source: Column, value: Column) -> Column:
    """transaction_context where a text tells what other transactions see and the source speaks of atomicity alone."""
    atomic = F.contains(source, F.lit("SQLite")) & F.rlike(source, F.lit("原子|全部发生或全部不发生")) & ~F.rlike(source, F.lit(r"提交[^。\n]*(?:崩溃|丢失|恢复|持久)"))
    told = F.exists(clauses(value), lambda c: F.rlike(c, F.lit(OTHERS_SEE)) & ~F.rlike(c, F.lit(SEE_OK)))
    return F.when(atomic & ~F.rlike(source, F.lit("隔离|快照|其他事务|另一事务|可见性")) & told, "transaction_context")


def term_issue(value: Column) -> Column:
    return F.when(clause_says(value, SENSITIVITY, TERM_BEFORE, TERM_AFTER, every=False), "term_conflation")


def continuation_issue(source: Column, summary: Column) -> Column:
    """task_continuation_scope where all other tasks are said to go on, finished ones too."""
    return F.when(F.contains(source, F.lit("Promise.all")) & clause_says(summary, GO_ON, GO_ON_BEFORE, GO_ON_AFTER), "task_continuation_scope")


# ---- recommendation


def bigrams(text: Column) -> Column:
    return X.ngrams(text)


def similarity(a: Column, b: Column, ga: Column, gb: Column, va: Column | None = None, vb: Column | None = None) -> Column:
    """1 for equal texts, else the cosine of their vectors from 0 to 1 where both have one, else shared bigrams."""
    lexical = D.lexical_similarity(ga, gb)
    told = lexical if va is None or vb is None else F.when(va.isNotNull() & vb.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), X.cosine(va, vb)))).otherwise(lexical)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(told)


def same_target(a: str, b: str) -> Column:
    """Whether candidates in columns a and b (structs of concept, topic_grams, target_grams, anchor_grams, base_topic) aim at the same thing."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    same = (x("concept") != "") & (x("concept") == y("concept"))
    like = lambda c: D.lexical_similarity(x(c), y(c))
    other_subject = (F.size(x("anchor_grams")) > 0) & (F.size(y("anchor_grams")) > 0) & (x("base_topic") != y("base_topic")) & (like("anchor_grams") < 0.65)
    return F.coalesce(same | (~F.coalesce(other_subject, F.lit(False)) & (like("topic_grams") >= 0.86) & (like("target_grams") >= 0.86)), F.lit(False))


def outline_fault(seed_known: Column, topic: Column, objective: Column, new: Column, knowledge: Column) -> Column:
    return (
        F.when(~seed_known, "unknown_seed").when(F.length(topic) < 4, "topic").when(F.length(objective) < 8, "objective").when(F.length(new) < 8, "new_knowledge").when(F.length(knowledge) < 60, "knowledge_text")
    )


def promise_issues(objective: Column, new: Column, content: Column) -> Column:
    """Which promises of a recommendation a draft's content breaks: less than 0.18 of the bigrams are there."""
    least = 0.18
    return F.array_compact(F.array(F.when(D.coverage(objective, content) < least, "discovery_objective"), F.when(D.coverage(new, content) < least, "discovery_novelty")))


def recall_exercise(card: Column, title: Column, objective: Column, boundaries: Column, answers: list[Column]) -> list[Column]:
    """id, answer and rubric of the recall exercise that every card can give by itself."""
    points = F.filter(F.array(*[X.clean_text(c, 240) for c in (objective, boundaries)]), lambda x: x != "")
    fallback = F.array(F.concat(F.lit("说出“"), X.clean_text(title, 80), F.lit("”的核心含义")), F.lit("说明一个适用条件或应用要点"))
    answer = X.clean_text(F.coalesce(*[F.nullif(c, F.lit("")) for c in answers]), 2000)
    return [F.concat(F.lit("exercise_review_recall_"), F.substring(X.stable_token(card), 1, 20)).alias("exercise"), answer.alias("answer"), F.when(F.size(points) > 0, points).otherwise(fallback).alias("rubric")]


# ---- sources


def decoded(content: Column) -> Column:
    """Text of a file: UTF-16 by its mark, else UTF-8, with line ends as \\n; null for blank, broken or too long ones and those with NUL."""
    mark = F.hex(F.substring(content, 1, 2))
    body = F.substring(content, 3, 2**31 - 1)
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\\uFEFF", ""))
    text = F.when(mark == "FFFE", F.decode(body, "UTF-16LE")).when(mark == "FEFF", F.decode(body, "UTF-16BE")).otherwise(utf8)
    text = F.regexp_replace(text, "\r\n?", "\n")
    return F.when((F.trim(text) != "") & ~F.contains(text, F.lit("\x00")) & (F.length(text) <= 2_000_000), text)


def file_fault(name: Column, content: Column) -> Column:
    """What is wrong with a file by its name and first bytes; null where nothing is."""
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    head = F.substring(content, 1, 1024)
    pdf = F.contains(F.decode(head, "ISO-8859-1"), F.lit("%PDF-"))
    return F.when(~kind.isin("pdf", "docx", "txt", "md", "markdown"), "kind").when((kind == "pdf") & ~pdf, "not_pdf").when((kind == "docx") & (F.hex(F.substring(content, 1, 2)) != "504B"), "not_docx")


# Parts of a page that are no text, and elements that stand on lines of their own.
_IGNORED = {"script", "style", "noscript", "template", "nav", "aside", "footer", "form", "button", "input", "select", "textarea"}
_ROLES = {"navigation", "complementary", "banner", "contentinfo", "dialog"}
_BLOCKS = {"p", "div", "section", "article", "main", "header", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "tr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Page(html.parser.HTMLParser):
    """Texts of articles, of main regions and of the whole body, in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, str | None]] = []  # tag, ignored, region
        self.open: dict[str, list[list[str]]] = {"article": [], "main": []}
        self.done: dict[str, list[str]] = {"article": [], "main": []}
        self.body: list[str] = []

    def put(self, text: str) -> None:
        if not any(i for _, i, _ in self.stack):
            for part in (self.body, *self.open["article"], *self.open["main"]):
                part.append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "br":
            self.put("\n")
        if tag in _VOID:
            return
        ignored = tag in _IGNORED or a.get("role") in _ROLES or (tag == "header" and self.stack[-1:] and self.stack[-1][0] == "body") or tag in ("head", "title")
        region = "article" if tag == "article" or a.get("role") == "article" or a.get("itemprop") == "articleBody" else "main" if tag == "main" or a.get("role") == "main" else None
        if region and not ignored:
            self.open[region].append([])
        self.stack.append((tag, bool(ignored), region if not ignored else None))
        if tag in _BLOCKS:
            self.put("\n")

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            if self.stack[-1][0] in _BLOCKS:
                self.put("\n")
            own, _, region = self.stack.pop()
            if region:
                self.done[region].append("".join(self.open[region].pop()))
            if own == tag:
                break

    def handle_data(self, data):
        self.put(data)


def compact(text: str) -> str:
    text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", text.replace("\xa0", " ")))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def page_text(source: str | None, most: int) -> tuple[str, str, bool]:
    """(text, method, truncated): the largest article, else the largest main region, else the body."""
    page = _Page()
    page.feed(source or "")
    page.close()
    for region in ("article", "main"):
        left = ["".join(x) for x in page.open[region]]
        found = max((compact(x) for x in page.done[region] + left), key=len, default="")
        if found:
            return found[:most], "article", len(found) > most
    text = compact("".join(page.body))
    return text[:most], "page", len(text) > most


def page_texts(pages: DataFrame, id_col: str, html_col: str, most: int = 262_144) -> DataFrame:
    """(id, text, method, truncated): what a page says, without its furniture; a null page says nothing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [page_text(x, most) for x in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"], "text": [t[0] for t in told], "method": [t[1] for t in told], "truncated": [t[2] for t in told]})

    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return source.mapInPandas(run, f"id {kind}, text string, method string, truncated boolean").withColumnRenamed("id", id_col)


def metric_rows(cases: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, value): the flat form of a report, a row for each case and metric."""
    return cases.unpivot([key], metrics, "metric", "value")


def write_report(cases: DataFrame, key: str, metrics: list[str], path: str) -> None:
    """Nested JSON of the cases, and a CSV of their metrics, below a path."""
    cases.write.mode("overwrite").json(f"{path}/report.json")
    metric_rows(cases, key, metrics).write.mode("overwrite").option("header", True).csv(f"{path}/metrics.csv")


# ---- references


def valid_reference(kind: Column, context: Column, card_text: Column, card_version: Column, document: Column, document_version: Column, quote: Column, start: Column, version: Column) -> Column:
    """Whether a quote is where it is said to be: in the context, in the card of that version, or at its place in the document."""
    at = lambda text: F.substring(text, start + 1, F.length(quote)) == quote
    told = F.when(kind == "context", at(context)).when(kind == "card", (card_version == version) & F.contains(card_text, quote)).otherwise((document_version == version) & at(document))
    return F.coalesce(told, F.lit(False))


def usable_citations(citations: DataFrame, sources: DataFrame, card: str, most: int = 3) -> DataFrame:
    """The first `most` citations of each card whose source is available, in that version, with the quote at its place."""
    from lorecraft.operators.library import first_rows

    told = citations.join(sources.filter("status = 'available'").drop("status").withColumnRenamed("version", "_v"), "doc_id")
    own = told.filter((F.col("_v") == F.col("version")) & (F.substring(F.col("content"), F.col("start") + 1, F.length("quote")) == F.col("quote")))
    return first_rows(own, [card], ["citation"], most)


# ---- cards, citations and conversations

# What citations may be about and come from, fields of a summary and phases of practice.
CITED_CLAIMS = ["summary", "analogy", "mantra", "question", "card", "exercise", "boundaries", "example"]
CITED_TYPES = ["text", "webpage", "pdf", "docx"]
COLOR = "^#[0-9A-Fa-f]{6}$"
MAX_CITED, MAX_CITED_LINKED = 8, 32


def clean_card(cards: DataFrame, color: str) -> DataFrame:
    """cards with texts squeezed and cut, a valid colour, mastery from 0 to 5, counts from 0 and a day."""
    from lorecraft.operators import scalars as V

    text = lambda c, n=None: V.squeezed(F.col(c)) if n is None else F.substring(V.squeezed(F.col(c)), 1, n)
    key = F.substring(F.regexp_replace(V.squeezed(F.col("id").cast("string")), "[^A-Za-z0-9_-]", "_"), 1, 128)
    return cards.select(
        key.alias("id"), F.coalesce(F.nullif(text("title"), F.lit("")), F.lit("知识点")).alias("title"), text("source", 120).alias("source"), text("summary").alias("summary"),
        F.when(F.rlike("color", F.lit(COLOR)), F.col("color")).otherwise(color).alias("color"), F.coalesce("favorite", F.lit(False)).alias("favorite"),
        V.bounded_integer(F.col("mastery"), 0, 5, 0).alias("mastery"), V.bounded_integer(F.col("review_count"), 0, 2**53 - 1, 0).alias("review_count"), text("day", 10).alias("day"),
    )


def valid_citations(citations: DataFrame, card: str, most: int = MAX_CITED) -> DataFrame:
    """The citations of each card that are well formed, of the first `most` by place, each id once."""
    from lorecraft.operators.library import first_rows

    c, quote = F.col, F.col("quote")
    good = (
        F.rlike("id", F.lit("^citation_[A-Za-z0-9_-]+$")) & F.rlike("chunk", F.lit("^chunk_[A-Za-z0-9_-]+$")) & F.rlike("doc", F.lit("^doc_[A-Za-z0-9_-]+$")) & c("claim").isin(CITED_CLAIMS) & c("type").isin(CITED_TYPES)
        & (X.trimmed(F.col("title")) != "") & (F.length("title") <= 512) & (c("url").isNull() | F.rlike("url", F.lit(r"(?i)^https?://\S+$"))) & (X.trimmed(quote) != "") & (quote == X.trimmed(quote)) & (F.length(quote) <= 2000)
        & (c("start") >= 0) & (c("end") > c("start")) & (F.length(quote) == c("end") - c("start")) & (c("page").isNull() | c("page").between(1, 100_000))
    )
    own = first_rows(citations, [card], ["place"], most, "_n").filter(good)
    return first_rows(own, [card, "id"], ["place"]).drop("_n", "rank")


def summary_valid(goal: Column, lists: list[Column], keys: Column, references: Column, covered_id: Column, pair_id: Column) -> Column:
    """Whether a summary's fields have their lengths, it ends at the turn it says, and its keys are among its references."""
    short = lambda x, most: (F.size(x) <= most) & F.forall(x, lambda i: (F.trim(i) != "") & (F.length(i) <= 320))
    good = (F.length(goal) <= 400) & short(keys, 8) & (F.size(references) <= 8) & (F.size(F.array_except(keys, references)) == 0) & (covered_id == pair_id)
    for x in lists:
        good = good & short(x, 6)
    return F.coalesce(good, F.lit(False))


def practice_fault(phase: Column, question: Column, hints: Column, previous: Column, previous_hints: Column, answer: Column) -> Column:
    """What is inconsistent in a turn of practice: the question is kept while an answer is awaited, and hints never go down."""
    same = question.isNotNull() & question.eqNullSafe(previous)
    visible = lambda t: F.regexp_replace(F.regexp_replace(t, r"\*\*|__|`", ""), r"\s+", "")
    waiting = phase == "awaiting_answer"
    return (
        F.when(question.isNotNull() & ((F.trim(question) == "") | (F.length(question) > 1200)), "question").when(hints.isNull() | ~hints.between(0, 5), "hints")
        .when((waiting & question.isNull()) | (~waiting & (question.isNotNull() | (hints != 0))), "phase").when(same & (hints < previous_hints), "hints_lowered")
        .when(question.isNotNull() & ~same & (hints != 0), "hints_at_start").when(question.isNotNull() & ~same & ~F.contains(visible(answer), visible(question)), "question_hidden")
    )


def reasons_of(reason: Column, preference: Column, target: Column, difficulty: Column) -> Column:
    """Reasons of a candidate: why its seed was taken, then a difficulty preference that applies."""
    own = F.struct(reason.alias("code"), F.lit(None).cast("string").alias("fits"))
    wish = F.struct(F.lit("difficulty_preference").alias("code"), F.when(target == difficulty, "as_preferred").otherwise("downranked").alias("fits"))
    return F.when(preference.isNotNull(), F.array(own, wish)).otherwise(F.array(own))


def evidence_bundle(parts: dict[str, tuple[DataFrame, int]], documents: DataFrame, key: str) -> DataFrame:
    """(key, origin, doc_id, start, quote): evidence of several origins, at most so many of each, whose quote is at its place.

    parts: origin -> (rows of key, doc_id, start, quote, score; most).
    """
    from lorecraft.operators.library import first_rows

    held = documents.select("doc_id", "content")
    own = []
    for origin, (rows, most) in parts.items():
        exact = rows.join(held, "doc_id").filter(F.substring(F.col("content"), F.col("start") + 1, F.length("quote")) == F.col("quote"))
        own.append(first_rows(exact, [key], [F.col("score").desc(), "doc_id", "start"], most).select(key, F.lit(origin).alias("origin"), "doc_id", "start", "quote"))
    out = own[0]
    for o in own[1:]:
        out = out.unionByName(o)
    return out


def variant_sources(references: DataFrame, key: str, locations: int = 8, most: int = 32) -> DataFrame:
    """(key, claim, doc_id, start, end): references at the first `locations` distinct places of each key, `most` in all."""
    from lorecraft.operators.library import first_rows

    place = references.groupBy(key, "doc_id", "start", "end").agg(F.min("place").alias("_first"))
    kept = first_rows(place, [key], ["_first"], locations).select(key, "doc_id", "start", "end")
    return first_rows(references.join(kept, [key, "doc_id", "start", "end"]), [key], ["place"], most).drop("rank")


def evidence_issues(references: DataFrame, sources: DataFrame, key: str, required: list[str], links: int = 32, places: int = 8) -> DataFrame:
    """(key, code) of references(key, place, claim, source, quote): too many links, quotes that aren't in their source, too many places, claims without any.

    sources(source, text). Only the first `links` references of a candidate are looked at.
    """
    from lorecraft.operators.library import first_rows

    own = first_rows(references, [key], ["place"], 2**31 - 1, "_n").join(sources, "source", "left")
    at = F.when(F.col("claim").isin("summary", "exercise", "boundaries", "example") & (F.trim("quote") != ""), F.nullif(F.instr("text", F.col("quote")), F.lit(0)))
    own = own.withColumn("_at", F.when(F.col("_n") <= links, at))
    per = own.groupBy(key).agg(
        (F.count("*") > links).alias("many"), (F.count_if((F.col("_n") <= links) & F.col("_at").isNull()) > 0).alias("lost"),
        (F.count_distinct(F.when(F.col("_at").isNotNull(), F.struct("source", "_at", F.length("quote")))) > places).alias("spread"), F.collect_set(F.when(F.col("_at").isNotNull(), F.col("claim"))).alias("claims"),
    )
    missing = F.size(F.array_except(F.array(*[F.lit(c) for c in required]), "claims")) > 0
    codes = F.array_compact(F.array(F.when(F.col("many"), "evidence_links_limit"), F.when(F.col("lost"), "evidence_location"), F.when(F.col("spread"), "evidence_limit"), F.when(missing, "evidence_coverage")))
    return per.select(key, F.explode(codes).alias("code"))


# How a question gives away the labels of an image.
IMAGE_OK, TRANSLATES = "错误|是否|正确吗|调换|互换|纠正|对吗", "翻译|英语|英文词汇"
LABEL = r"[“\"]([A-Za-z][A-Za-z0-9 _-]{2,40})[”\"]"


def image_leak(goal: Column, observations: Column, question: Column, answer: Column) -> Column:
    """image_answer_leak where a question names what is to be recognised, and the answer says it again."""
    labels = F.array_distinct(F.regexp_extract_all(observations, F.lit(LABEL), F.lit(1)))
    given = F.filter(labels, lambda x: F.contains(question, x))
    mapping = (F.size(given) >= 3) & F.rlike(question, F.lit("从左到右|从上到下")) & F.rlike(question, F.lit("依次|分别"))
    named = F.rlike(question, F.lit("标签(?:为|是)|标注为")) & F.rlike(question, F.lit("区域(?:对应|代表|是)"))
    free = F.rlike(goal, F.lit(TRANSLATES)) | F.rlike(question, F.lit(IMAGE_OK))
    return F.when(~free & (mapping | named) & F.exists(given, lambda x: F.contains(answer, x)), "image_answer_leak")


class HashedBigrams:
    """A deterministic embedding without a model: bigrams of the lower-case text, hashed to signed places, unit length."""

    # Factors of the hash of two code points.
    FIRST, SECOND = 2654435761, 2246822519
    #: Code points that are hashed at once.
    BLOCK = 1 << 18

    def __init__(self, dimensions: int = 64):
        self.dimensions, self.fingerprint = dimensions, f"hashed-bigrams-{dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out, own, size, first = np.zeros((len(texts), self.dimensions)), [], 0, 0
        for i, text in enumerate(texts, 1):
            own.append(np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le"), "<u4"))
            size += len(own[-1])
            if size >= self.BLOCK or i == len(texts):
                self.count(own, out[first:i])
                own, size, first = [], 0, i
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).tolist()

    def count(self, codes: list[np.ndarray], out: np.ndarray) -> None:
        """Adds the signed bigrams of each text to its row of out, a block of all of them at a time."""
        # one that goes from a text into the next doesn't count
        rows, flat = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes]), np.concatenate(codes)
        for at in range(0, len(flat) - 1, self.BLOCK):
            row, c = rows[at : at + self.BLOCK + 1], flat[at : at + self.BLOCK + 1].astype(np.int64)
            own = row[1:] == row[:-1]
            h = ((c[:-1] * self.FIRST + c[1:] * self.SECOND) & 0xFFFFFFFF)[own]
            place = row[:-1][own].astype(np.int64) * self.dimensions + (h >> 16) % self.dimensions
            out += np.bincount(place, np.where(h >> 31, 1.0, -1.0), out.size).reshape(out.shape)


#: Texts of one call of a model.
EMBEDDED = 512


def embedded(entries: DataFrame, id_col: str, text_col: str, embedding=None) -> DataFrame:
    """(id, model, embedding) of entries by any object with `fingerprint` and `embed(texts)`, EMBEDDED texts at a time in the tasks."""
    model = embedding or HashedBigrams()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), EMBEDDED):
                pdf = batch.iloc[at : at + EMBEDDED]
                yield pd.DataFrame({"id": pdf["id"], "model": model.fingerprint, "embedding": model.embed(pdf["text"].tolist())})

    kind = entries.schema[id_col].dataType.simpleString()
    source = entries.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInPandas(run, f"id {kind}, model string, embedding array<double>").withColumnRenamed("id", id_col)
