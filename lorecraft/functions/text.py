"""Column functions on text: cleaning, hashing, analyzers and similarities."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stop words and synonym groups of the analyzers.
STOP_WORDS = [
    "可以", "一个", "这个", "我们", "什么", "如何", "能够", "解释", "判断", "学习", "内容", "材料", "以及", "进行", "需要", "的", "了", "是", "在", "和", "与", "能",
    "the", "a", "is", "of", "to", "and",
]
SYNONYMS = [
    ["缓存", "快取", "cache"], ["并发", "同时执行", "concurrency"], ["边际成本", "增量成本", "额外成本"], ["召回", "检索命中", "recall"],
    ["幂等", "重复执行", "idempotent"], ["过期时间", "有效期", "ttl"], ["事务", "transaction"], ["复习", "回顾", "温习"],
]
LATIN = r"[a-z0-9_]+"
HAN = r"[\x{3400}-\x{9fff}]+"


#: A character that NFKC may change or join with the one before: all but these, which stay as they are beside each other.
NOT_PLAIN = (
    r"[\x{80}-\x{10FFFF}&&[^\xC0-\xFF\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF\x{100}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{391}-\x{3A1}\x{3A3}-\x{3CF}\x{400}-\x{482}\x{48A}-\x{52F}"
    r"\x{2013}-\x{2016}\x{2018}-\x{2023}\x{20AC}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FE}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]]"
)
#: Texts that are normalised together.
NFKC_ROWS = 256


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    own = lambda part: pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string())
    return pa.concat_arrays([own(texts.slice(at, NFKC_ROWS)) for at in range(0, len(texts), NFKC_ROWS)] or [texts])


#: Space separators of any script, which the trim of SQL takes off too.
SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Text without space separators of any script at both ends."""
    return F.btrim(text, F.lit(SEPARATORS))


def let(value: Column, body) -> Column:
    """body(value), where value is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def nfkc(text: Column) -> Column:
    """NFKC; only texts that it may change go to Python, which would else get every row, whatever the condition around it."""
    return F.coalesce(_nfkc(F.when(F.rlike(text, F.lit(NOT_PLAIN)), text)), text)


def normalize_text(text: Column) -> Column:
    return F.lower(nfkc(F.coalesce(text, F.lit(""))))


def shortened(text: Column, limit: int | None) -> Column:
    """The first `limit` characters; without a limit the whole text."""
    return text if limit is None else F.substring(text, 1, limit)


def collapse(text: Column, limit: int | None = 200) -> Column:
    """White space runs to one space, trimmed, cut; text is normalised already."""
    return shortened(F.trim(F.regexp_replace(text, r"\s+", " ")), limit)


def clean_text(text: Column, limit: int = 200) -> Column:
    return collapse(nfkc(F.coalesce(text, F.lit(""))), limit)


def semantic_text(text: Column, limit: int | None = 600, clean=clean_text) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(clean(text, limit)), r"[\p{P}\p{S}\s]+", "")


def code_points(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def matches(text: Column, pattern: str) -> Column:
    """All matches in order, as an array of (quote, at): what matched and where it begins, from 0.

    The parts between matches are what a split by the same pattern gives, so their lengths tell
    the places.
    """
    text = F.coalesce(text, F.lit(""))
    parts = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern), lambda quote, gap: F.struct(quote.alias("quote"), F.length(gap).alias("gap")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<quote:string,at:int>>").alias("out"))

    def add(done: Column, part: Column) -> Column:
        at = done["end"] + part["gap"]
        own = F.struct(part["quote"].alias("quote"), at.alias("at"))
        return F.struct((at + F.length(part["quote"])).alias("end"), F.concat(done["out"], F.array(own)).alias("out"))

    return F.aggregate(F.filter(parts, lambda x: x["quote"].isNotNull()), start, add, lambda done: done["out"])


def head(text: Column, at: Column) -> Column:
    """What stands before a place."""
    return F.substring(text, F.lit(1), at)


def tail(text: Column, at: Column) -> Column:
    """What stands from a place on."""
    return F.substring(text, at + 1, F.length(text))


def _folded(text: Column, start: int, step) -> Column:
    return F.aggregate(code_points(text), F.lit(start).cast("long"), step)


def stable_token(text: Column) -> Column:
    """FNV-1a of 32 bits over characters, as eight hexadecimal digits four times."""
    # a character beyond the basic plane counts by its high surrogate
    unit = lambda c: F.when(F.ascii(c) > 65535, F.shiftright(F.ascii(c) - 65536, 10) + 55296).otherwise(F.ascii(c)).cast("long")
    h = _folded(text, 2166136261, lambda h, c: (h.bitwiseXOR(unit(c)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.repeat(F.lpad(F.lower(F.hex(h)), 8, "0"), 4)


#: White space as the texts of cards have it: of any script, and the mark of byte order.
SPACES = r"[\s\p{Z}\x{FEFF}]+"


def squeezed(text: Column) -> Column:
    """White space of any kind to one space, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def hash_text(text: Column) -> Column:
    """The polynomial of base 31 over the 16-bit units of the squeezed text, modulo 2^32."""
    step = lambda h, unit: (h * F.lit(31) + unit.cast("long")).bitwiseAND(F.lit(4294967295))

    def fold(h: Column, c: Column) -> Column:
        code, beyond = F.ascii(c), F.ascii(c) - 65536
        return F.when(code <= 65535, step(h, code)).otherwise(step(step(h, F.shiftright(beyond, 10) + 55296), beyond.bitwiseAND(F.lit(1023)) + 56320))

    return _folded(squeezed(text), 0, fold)


def topic_label(text: Column) -> Column:
    return F.nullif(clean_text(text, 120), F.lit(""))


def topic_id(label: Column) -> Column:
    return F.when(label.isNotNull(), F.concat(F.lit("topic_"), F.substring(stable_token(F.lower(label)), 1, 16)))


def ngrams(text: Column, n: int = 2) -> Column:
    """All substrings of n characters, in order."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def grams(text: Column) -> Column:
    """Distinct bigrams; one character gives itself."""
    # a filter that Spark infers may hold the whole expression of the text: it is worked out once even there
    return let(text, lambda t: F.when(F.length(t) == 1, F.array(t)).otherwise(F.array_distinct(ngrams(t))))


def _words(text: Column) -> Column:
    han = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(HAN), F.lit(0)), lambda run: ngrams(run)))
    words = F.concat(F.regexp_extract_all(text, F.lit(LATIN), F.lit(0)), han)
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def tokens(text: Column) -> Column:
    """Bag of words: Latin words and Han bigrams as often as they occur, without stop words; text is normalised already."""
    return let(text, _words)


def synonym_tags(text: Column) -> Column:
    tags = [F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in group]), f"synonym_{i}") for i, group in enumerate(SYNONYMS)]
    return F.array_compact(F.array(*tags))


def terms(text: Column) -> Column:
    """Set of words and the tags of synonym groups that occur; text is normalised already."""
    return let(text, lambda t: F.array_distinct(F.concat(_words(t), synonym_tags(t))))


def token_similarity(a: Column, b: Column) -> Column:
    """Shared words over those of the smaller set; 0 where one has none."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))


def collapse_repetition(text: Column, limit: int | None = 600) -> Column:
    """One copy of a text that repeats a period, then its distinct sentences in order; null is empty.

    Periods are divisors of the length, which come in pairs with one up to its root.
    """

    def once(t: Column, n: Column) -> Column:
        small = F.filter(F.sequence(F.lit(1), F.greatest(F.floor(F.sqrt(n)).cast("int"), F.lit(1))), lambda p: n % p == 0)
        some = F.filter(F.concat(small, F.transform(small, lambda p: (n / p).cast("int"))), lambda p: p.between(F.lit(1), F.greatest(F.floor(n / 2).cast("int"), F.lit(1))))
        period = F.array_min(F.filter(some, lambda p: F.substring(t, p + 1, n) == F.substring(t, F.lit(1), n - p)))
        return F.substring(t, F.lit(1), F.coalesce(period, n))

    # the length is counted once: inside a lambda each look at it would read the whole text again
    whole = let(F.coalesce(text, F.lit("")), lambda t: let(F.length(t), lambda n: once(t, n)))
    parts = F.filter(F.transform(F.split(whole, r"[。！？!?；;\n]+"), lambda x: trimmed(x)), lambda x: x != "")
    return shortened(F.array_join(F.array_distinct(parts), "。 "), limit)


def sentences(text: Column, least: int = 8, most: int = 8) -> Column:
    """The first sentences of the squeezed text that are long enough; a line end is no end of a sentence."""
    parts = F.transform(F.split(squeezed(text), r"[。！？!?；;.]"), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: F.length(x) >= least), 1, most)


# What introduces a definition, and what separates key words.
DEFINED = r"(?:^|[。！？；，,\s])([\x{4e00}-\x{9fff}]{2,10})(?:是指|指的是|指|是)"
NOT_KEY = r"[A-Za-z0-9_\-，。！？、；：,.!?;:\"'()（）\[\]【】]"


def keywords(text: Column, most: int = 6) -> Column:
    """Distinct concepts that the text defines, then Latin words of three letters or more, then other words of 2 to 10 characters.

    A longer word of another script is left out, not cut.
    """

    def of(t: Column) -> Column:
        rest = F.filter(F.split(F.regexp_replace(t, NOT_KEY, " "), r"\s+"), lambda x: F.length(x).between(2, 10))
        return F.concat(F.regexp_extract_all(t, F.lit(DEFINED), F.lit(1)), F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), rest)

    return F.slice(F.array_distinct(let(squeezed(text), lambda t: of(t))), 1, most)


def compact_title(text: Column, fallback: str, n: int = 10) -> Column:
    """The squeezed text, its first n characters and an ellipsis where it is longer; the fallback for a blank one."""
    return let(squeezed(text), lambda t: F.when(t == "", F.lit(fallback)).otherwise(ellipsis(t, n)))


def short_text(text: Column, limit: int) -> Column:
    """The squeezed text in at most so many characters, the last one an ellipsis where something is cut."""
    return let(squeezed(text), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, max(0, limit - 1)), F.lit("…"))))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return (F.ceil(F.octet_length(text) / 2) + 16).cast("long")


def needs_plan(text: Column, heading_blocks: Column | None = None) -> Column:
    """Whether a text is long, or has several heading blocks, or several headings or numbered lines."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)(^#{1,6}\s+\S|^\s*\d+[.、)]\s*\S)"), F.lit(0))
    blocks = F.lit(0) if heading_blocks is None else F.coalesce(heading_blocks, F.lit(0))
    return (F.length(text) > 1200) | (blocks > 1) | (F.size(lines) > 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for unequal lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def page_ranges(spec: Column) -> Column:
    """Sorted distinct pages of a list such as 1-5,8."""
    def pages(part: Column) -> Column:
        ends = F.transform(F.split(part, "-"), lambda x: F.trim(x).try_cast("int"))
        return F.sequence(F.get(ends, 0), F.element_at(ends, -1))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), pages))))


# Words of each intent, in the order in which they are tried.
INTENTS = [("citation", "引用|来源|依据|citation"), ("review", "复习|薄弱|review"), ("card", "卡片|制卡|保存|card"), ("discovery", "发现|推荐|探索")]


def intent(text: Column) -> Column:
    """The first intent whose words occur, whatever their case, else explain."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda c, r: c.when(F.rlike(low, F.lit(r[1])), r[0]), INTENTS, F).otherwise("explain")
