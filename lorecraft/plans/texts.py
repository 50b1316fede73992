"""Queries of text functions, windows and blocks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.functions import text as X
from lorecraft.operators import chunking as C
from lorecraft.plans.registry import Registry

query = Registry()

_STOP = "['the', 'a', 'is', 'of', 'to', 'and']"
TOK = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9_]+'), lambda w: NOT list_contains({_STOP}, w))"
# tags of the groups with a word in Latin letters, which are those that these tables can hold
_TAGS = [(0, "cache"), (1, "concurrency"), (3, "recall"), (4, "idempotent"), (5, "ttl"), (6, "transaction")]
TERMS = "list_distinct(list_concat(" + TOK + ", list_filter([" + ", ".join(f"CASE WHEN contains(lower({{}}), '{w}') THEN 'synonym_{i}' END" for i, w in _TAGS) + "], lambda t: t IS NOT NULL)))"
_SEM = "regexp_replace(lower({}), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')"


def tok(c: str) -> str:
    return TOK.format(c)


def terms(c: str) -> str:
    return TERMS.format(*[c] * (1 + len(_TAGS)))


def semantic(c: str, whole: bool = False) -> str:
    squeezed = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return _SEM.format(squeezed if whole else f"substr({squeezed}, 1, 600)")


@query("FN5_stable_token", """SELECT item_id, repeat(lpad(lower(to_hex(list_reduce(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN 55296 + (unicode(c) - 65536) // 1024 ELSE unicode(c) END::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT))), 8, '0'), 4) AS token FROM benchmark""")
def fn5(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", X.stable_token(F.col("text")).alias("token"))


#: In SQL: white space squeezed.
_SQUEEZED = "trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\p{Z}]+', ' ', 'g'))"
_UNITS = """list_concat(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) <= 65535 THEN [unicode(c)::BIGINT] ELSE [55296 + (unicode(c) - 65536)::BIGINT // 1024, 56320 + (unicode(c) - 65536)::BIGINT % 1024] END), [])"""


@query("FN6_hash_text", f"""SELECT item_id, list_reduce(flatten({_UNITS.format("t")}), lambda h, c: (h * 31 + c) & 4294967295, 0::BIGINT) AS hash
  FROM (SELECT item_id, {_SQUEEZED} AS t FROM (SELECT item_id, text || chr(10) || '  😀 ' || item_id AS text FROM benchmark))""")
def fn6(spark, d):
    """Texts with more white space and a character of two units."""
    text = F.concat("text", F.lit("\n  😀 "), F.col("item_id").cast("string"))
    return B.table(spark, d, "benchmark").select("item_id", X.hash_text(text).alias("hash"))


@query("FN4_topic", f"""SELECT DISTINCT source, 'topic_' || substr(repeat(lpad(lower(to_hex(list_reduce(list_transform(string_split(lower(source), ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT))), 8, '0'), 4), 1, 16) AS topic_id FROM documents WHERE source <> ''""")
def fn4(spark, d):
    own = B.documents(spark, d).select("source").filter("source <> ''").distinct()
    return own.select("source", X.topic_id(X.topic_label(F.col("source"))).alias("topic_id"))


@query("FN2_clean_text", "SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 200) AS cleaned FROM documents")
def fn2(spark, d):
    return B.documents(spark, d).select("doc_id", X.clean_text(F.col("text"), 200).alias("cleaned"))


@query("FN3_semantic_text", f"SELECT doc_id, {semantic('text')} AS semantic FROM documents")
def fn3(spark, d):
    return B.documents(spark, d).select("doc_id", X.semantic_text(F.col("text")).alias("semantic"))


@query("FN7_terms", f"SELECT doc_id, len({terms('text')})::INT AS n_terms, array_to_string(list_sort({terms('text')}), ' ') AS terms FROM documents")
def fn7(spark, d):
    t = X.terms(X.normalize_text(F.col("text")))
    return B.documents(spark, d).select("doc_id", t.alias("_t")).select("doc_id", F.size("_t").alias("n_terms"), F.array_join(F.array_sort("_t"), " ").alias("terms"))


@query("FN8_tokens", f"SELECT doc_id, len({tok('text')})::INT AS n_tokens, len(list_distinct({tok('text')}))::INT AS n_distinct FROM documents")
def fn8(spark, d):
    t = X.tokens(X.normalize_text(F.col("text")))
    return B.documents(spark, d).select("doc_id", t.alias("_t")).select("doc_id", F.size("_t").alias("n_tokens"), F.size(F.array_distinct("_t")).alias("n_distinct"))


@query("FN11_bigrams", f"SELECT item_id, len(list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))))::INT AS n_grams FROM (SELECT item_id, {semantic('text')} AS s FROM benchmark)")
def fn11(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", F.size(X.grams(X.semantic_text(F.col("text"), clean=X.collapse))).alias("n_grams"))


@query("FN13_repetition", """WITH d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents),
p AS (SELECT doc_id, coalesce(min(k), 0) AS period FROM (SELECT doc_id, t, n, unnest(list_filter(range(1, greatest(n // 2, 1) + 1), lambda k: n % k = 0)) AS k FROM d) WHERE repeat(substr(t, 1, k::INT), (n // k)::INT) = t GROUP BY doc_id),
o AS (SELECT d.doc_id, CASE WHEN coalesce(period, 0) > 0 THEN substr(t, 1, period::INT) ELSE t END AS t FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
s AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, trim(unnest(l)) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '[。！？!?；;\\n]+') AS l FROM o)) WHERE x <> '' GROUP BY doc_id, x)
SELECT d.doc_id, substr(coalesce(string_agg(x, '。 ' ORDER BY i), ''), 1, 600) AS collapsed FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id""")
def fn13(spark, d):
    return B.documents(spark, d).select("doc_id", X.collapse_repetition(F.col("text")).alias("collapsed"))


@query("FN14_sentences", f"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_SQUEEZED}, '[。！？!?；;.]'), lambda x: trim(x)), lambda x: length(x) >= 8)[1:8], '|') AS sentences FROM documents""")
def fn14(spark, d):
    return B.documents(spark, d).select("doc_id", F.array_join(X.sentences(F.col("text")), "|").alias("sentences"))


@query("FN16_short_texts", f"""SELECT doc_id, CASE WHEN t = '' THEN '-' WHEN length(t) > 10 THEN substr(t, 1, 10) || '…' ELSE t END AS title, CASE WHEN length(t) <= 40 THEN t ELSE substr(t, 1, 39) || '…' END AS short
  FROM (SELECT doc_id, {_SQUEEZED} AS t FROM documents)""")
def fn16(spark, d):
    return B.documents(spark, d).select("doc_id", X.compact_title(F.col("text"), "-").alias("title"), X.short_text(F.col("text"), 40).alias("short"))


@query("FN25_page_ranges", """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(range(1 + turn % 4, 4 + turn % 4), [turn % 9 + 2]))), ',') AS pages FROM conversations""")
def fn25(spark, d):
    t = F.col("turn")
    spec = F.concat((1 + t % 4).cast("string"), F.lit("-"), (3 + t % 4).cast("string"), F.lit(", "), (t % 9 + 2).cast("string"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.page_ranges(spec), ",").alias("pages"))


@query("FN26_token_estimate", "SELECT conv_id, sum(ceil(octet_length(encode(text)) / 2) + 16)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def fn26(spark, d):
    return B.table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


@query("FN30_intent", """SELECT CASE WHEN regexp_matches(lower(text), '引用|来源|依据|citation') THEN 'citation' WHEN regexp_matches(lower(text), '复习|薄弱|review') THEN 'review'
WHEN regexp_matches(lower(text), '卡片|制卡|保存|card') THEN 'card' WHEN regexp_matches(lower(text), '发现|推荐|探索') THEN 'discovery' ELSE 'explain' END AS intent, count(*) AS messages FROM conversations GROUP BY 1""")
def fn30(spark, d):
    return B.table(spark, d, "conversations").groupBy(X.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("messages"))


@query("FN33_needs_plan", "SELECT doc_id, length(text) > 1200 OR len(regexp_extract_all(text, '(?m)(?:^#{1,6}\\s+\\S|^\\s*\\d+[.、)]\\s*\\S)')) > 1 AS needs_plan FROM documents")
def fn33(spark, d):
    return B.documents(spark, d).select("doc_id", X.needs_plan(F.col("text")).alias("needs_plan"))


@query("FN35_cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def fn35(spark, d):
    v = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("CH6_sliding_windows", """SELECT doc_id, s AS start, s + length(substr(text, s + 1, 360)) AS "end", substr(text, s + 1, 360) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 360) / 320.0)::INT) * 320 + 1, 320))::INT AS s FROM documents WHERE length(text) > 0)""")
def ch6(spark, d):
    return C.sliding_windows(B.documents(spark, d), "doc_id", "text")


@query("CH10_assembled_blocks", """SELECT conv_id, turn, coalesce(sum(length(t) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
(coalesce(sum(length(t) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(t))::BIGINT AS "end" FROM (SELECT conv_id, turn, trim(text) AS t FROM conversations) WHERE length(t) > 0""")
def ch10(spark, d):
    return C.assembled(B.table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("CH12_repeated_margins", """WITH l AS (SELECT source, doc_id, unnest(string_split('Source page ' || doc_id || chr(10) || text, chr(10))) AS line FROM documents),
s AS (SELECT DISTINCT source, doc_id, substr(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '\\s+', '', 'g'), 1, 160) AS signature FROM l)
SELECT source, signature, count(*) AS pages FROM s JOIN (SELECT source, count(DISTINCT doc_id) AS n FROM l GROUP BY source) t USING (source) WHERE signature <> '' GROUP BY source, signature, n HAVING count(*) >= greatest(2, ceil(n * 6 / 10))""")
def ch12(spark, d):
    lines = B.documents(spark, d).select("source", "doc_id", F.explode(F.split(F.concat(F.lit("Source page "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")), "\n")).alias("line"))
    return C.repeated_margins(lines, "source", "doc_id", "line")


@query("CH15_sparse_pages", "SELECT doc_id, length(regexp_replace(text, '[\\s\\p{P}\\p{N}]', '', 'g')) < 12 AS needs_ocr FROM documents")
def ch15(spark, d):
    return B.documents(spark, d).select("doc_id", C.sparse(F.col("text")).alias("needs_ocr"))


@query("CH17_context_expansion", """WITH c AS (SELECT conv_id, turn, role, turn % 5 = 2 AS hit FROM conversations),
n AS (SELECT *, coalesce((lag(hit) OVER w AND lag(role) OVER w = role), FALSE) OR coalesce((lead(hit) OVER w AND lead(role) OVER w = role), FALSE) AS near FROM (SELECT conv_id, turn, hit, (turn // 3)::VARCHAR AS role FROM c) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN hit THEN 'hit' ELSE 'neighbour' END AS role FROM n WHERE hit OR near""")
def ch17(spark, d):
    chunks = B.table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 3).cast("string").alias("heading"))
    return C.expanded(chunks, chunks.filter("turn % 5 = 2"), "conv_id", "turn", "heading").select("conv_id", "turn", "role")


@query("CH18_excerpt", """SELECT doc_id, substr(text, greatest(a - 80, 0)::INT + 1, (a - greatest(a - 80, 0))::INT) AS before, substr(text, a::INT + 1, 40) AS highlight, substr(text, a::INT + 41, 80) AS after FROM (SELECT doc_id, text, length(text) // 2 AS a FROM documents)""")
def ch18(spark, d):
    a = F.floor(F.length("text") / 2).cast("int")
    own = B.documents(spark, d).select("doc_id", "text", a.alias("a"))
    return own.select("doc_id", *[c.alias(k) for k, c in C.excerpt(F.col("text"), F.col("a"), F.col("a") + 40).items()])


@query("CH19_range_compaction", """SELECT conv_id, role, min(turn) AS first, max(turn) AS last FROM (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations) GROUP BY conv_id, role, g""")
def ch19(spark, d):
    return C.compacted(B.table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("CH3_block_violations", """WITH b AS (SELECT doc_id, i * 100 AS s, i * 100 + 100 - (doc_id + i) % 3 + CASE WHEN (doc_id + i) % 11 = 0 THEN 20 ELSE 0 END AS e, text FROM documents, range(0, 4) r(i)),
c AS (SELECT doc_id, s AS start, e AS "end", text, CASE WHEN (doc_id + s) % 7 = 0 THEN 'x' ELSE substr(text, s::INT + 1, (e - s)::INT) END AS t FROM b),
f AS (SELECT *, CASE WHEN lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end") > start THEN 'overlap' WHEN substr(text, start::INT + 1, ("end" - start)::INT) <> t THEN 'text_differs' END AS fault FROM c)
SELECT doc_id, start, "end", fault FROM f WHERE fault IS NOT NULL""")
def ch3(spark, d):
    docs = B.documents(spark, d).select("doc_id", F.col("text").alias("content"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    b = docs.withColumn("i", i).withColumn("start", F.col("i") * 100)
    b = b.withColumn("end", F.col("start") + 100 - (F.col("doc_id") + F.col("i")) % 3 + F.when((F.col("doc_id") + F.col("i")) % 11 == 0, 20).otherwise(0))
    cut = F.substring(F.col("content"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    blocks = b.select("doc_id", "start", "end", F.when((F.col("doc_id") + F.col("start")) % 7 == 0, "x").otherwise(cut).alias("text"))
    return C.violations(blocks.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text"), docs, "doc_id").select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "fault"
    )
