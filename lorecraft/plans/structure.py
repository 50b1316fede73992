"""Queries of structure, corpus and hybrid search, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import chunking as C
from lorecraft.operators import conversation as V
from lorecraft.operators import library as L
from lorecraft.operators import retrieval as R
from lorecraft.operators import structure as S
from lorecraft.plans.registry import Registry
from lorecraft.plans.retrieval import _OVER, DENSE, overlap

query = Registry()
_MD = "'# S' || source || chr(10) || text || chr(10) || '## Notes' || chr(10) || '| a | b |' || chr(10) || substr(text, 1, 40)"
_BLOCKS = f"""WITH md AS (SELECT doc_id, source, {_MD} AS md FROM documents), l AS (SELECT doc_id, source, md, unnest(string_split(md, chr(10))) AS line, unnest(range(len(string_split(md, chr(10))))) AS i FROM md),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
k AS (SELECT *, least(s + length(line) + 1, length(md)) AS e, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN 'heading' WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 'blank' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' ELSE 'paragraph' END AS kind FROM o WHERE s < length(md)),
n AS (SELECT *, max(CASE WHEN line = '## Notes' THEN i END) OVER (PARTITION BY doc_id) AS notes, (kind <> lag(kind, 1, '') OVER w OR kind = 'heading')::INT AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n),
bl AS (SELECT doc_id, min(s)::INT AS start, max(e)::INT AS "end", any_value(kind) AS kind, CASE WHEN min(i) >= any_value(notes) THEN 'S' || any_value(source) || ' / Notes' ELSE 'S' || any_value(source) END AS path FROM g WHERE kind <> 'blank' GROUP BY doc_id, g)
"""


def markdown(spark, d):
    text = F.concat(F.lit("# S"), F.col("source"), F.lit("\n"), F.col("text"), F.lit("\n## Notes\n| a | b |\n"), F.substring("text", 1, 40))
    return B.documents(spark, d).select("doc_id", "source", text.alias("text"))


@query("CH1_block_kinds", _BLOCKS + 'SELECT doc_id, start, "end", kind FROM bl')
def ch1(spark, d):
    return S.structure_blocks(markdown(spark, d), "doc_id", "text").select("doc_id", "start", "end", "kind")


@query("CH2_heading_paths", _BLOCKS + "SELECT doc_id, start, path FROM bl")
def ch2(spark, d):
    return S.structure_blocks(markdown(spark, d), "doc_id", "text").select("doc_id", "start", F.array_join("heading_path", " / ").alias("path"))


@query("CH4_packed_paragraphs")
def ch4(spark, d):
    return S.structure_blocks(markdown(spark, d), "doc_id", "text", join=True)


@query("CH5_chunks")
def ch5(spark, d):
    return S.chunks(markdown(spark, d), "doc_id", "text")


def corpus(spark, d):
    docs = S.linked(markdown(spark, d), B.table(spark, d, "labels"), "doc_id")
    cards = B.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.substring("text", 1, 40).alias("title"), "text")
    return S.corpus(docs, cards, "doc_id", "text")


@query("CH7_corpus")
def ch7(spark, d):
    return corpus(spark, d)


@query("CH8_linked", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS linked FROM documents")
def ch8(spark, d):
    return S.linked(B.documents(spark, d).select("doc_id"), B.table(spark, d, "labels"), "doc_id")


_ENTRIES = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'card' ELSE 'document' END AS type, doc_id % 50 AS owner, doc_id IN (SELECT doc_id FROM labels) AS linked FROM documents"


def entries(spark, d):
    i = F.col("doc_id")
    return S.linked(B.documents(spark, d).select("doc_id", F.when(i % 5 == 0, "card").otherwise("document").alias("type"), (i % 50).alias("owner")), B.table(spark, d, "labels"), "doc_id")


@query("CH9_scope", f"SELECT doc_id FROM ({_ENTRIES}) WHERE type = 'document' AND owner <> 7 AND linked")
def ch9(spark, d):
    return S.in_scope(entries(spark, d), "document", 7, only_linked=True).select("doc_id")


@query("CH11_selected_blocks", """WITH w AS (SELECT conv_id, turn AS block FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT DISTINCT conv_id, 999 FROM conversations WHERE conv_id % 4 = 0)
SELECT w.conv_id, count(c.turn) AS blocks, coalesce(sum(length(c.text)), 0)::BIGINT AS characters, CASE WHEN count(*) > count(c.turn) THEN 'missing' WHEN sum(length(c.text)) > 400 THEN 'too_long' END AS fault FROM w LEFT JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.block GROUP BY w.conv_id""")
def ch11(spark, d):
    c = B.table(spark, d, "conversations")
    found = c.select("conv_id", F.col("turn").alias("block"), F.length("text").alias("length"))
    wanted = found.filter("block % 2 = 0").select("conv_id", "block").unionByName(c.filter("conv_id % 4 = 0").select("conv_id", F.lit(999).cast("long").alias("block")).distinct())
    return S.selected_blocks(found, wanted, "conv_id", 400)


@query("CH16_analysis_batches", """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) + 30 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
r AS (SELECT conv_id, turn, i, n AS used, 0 AS batch FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.turn, c.i, CASE WHEN r.used + c.n > 400 THEN c.n ELSE r.used + c.n END, CASE WHEN r.used + c.n > 400 THEN r.batch + 1 ELSE r.batch END FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.i + 1)
SELECT conv_id, turn, batch FROM r""")
def ch16(spark, d):
    return S.batches(B.table(spark, d, "conversations").withColumn("n", F.length("text") + 30), "conv_id", "turn", "n", 400)


@query("CH20_overlapping_blocks", """SELECT doc_id, s AS start FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 360) / 320.0)::INT) * 320 + 1, 320))::INT AS s FROM documents WHERE length(text) > 0) WHERE s < 700 AND s + length(substr(text, s + 1, 360)) > 500""")
def ch20(spark, d):
    return C.sliding_windows(B.documents(spark, d), "doc_id", "text").filter((F.col("start") < 700) & (F.col("end") > 500)).select("doc_id", "start")


_HYBRID = _OVER + f""", e AS ({_ENTRIES}), lx AS (SELECT query_id, doc_id, score AS ls, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM over WHERE score >= 0.18),
dn0 AS (SELECT b.item_id AS query_id, o.doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS ds FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, documents o JOIN embeddings v ON v.vec_id = o.doc_id WHERE b.item_id <> o.doc_id),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ds DESC, doc_id) AS r FROM dn0 WHERE ds >= {DENSE}),
fu AS (SELECT query_id, doc_id, round(sum(p), 6) AS score, max(ls) AS lexical_score, max(ds) AS dense_score FROM (SELECT query_id, doc_id, 1.25 * (61 / 2.25) / (60 + r) AS p, ls, NULL::DOUBLE AS ds FROM lx UNION ALL SELECT query_id, doc_id, (61 / 2.25) / (60 + r), NULL, ds FROM dn) GROUP BY ALL),
ca AS (SELECT fu.*, row_number() OVER (PARTITION BY query_id, type, owner ORDER BY score DESC, fu.doc_id) AS n, type FROM fu JOIN e USING (doc_id)),
hy AS (SELECT query_id, doc_id, score, lexical_score, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ca WHERE n <= CASE type WHEN 'card' THEN 1 ELSE 2 END QUALIFY rank <= 5)
"""


def hybrid(spark, d):
    lexical = overlap(spark, d).filter(F.col("score") >= R.OVERLAP_LEAST).select("query_id", "doc_id", "score")
    v = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    q = B.queries(spark, d).select("query_id").join(v.withColumnRenamed("vec_id", "query_id"), "query_id")
    vectors = B.documents(spark, d).select("doc_id").join(v.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return R.hybrid(lexical, R.dense(q, vectors, "doc_id", DENSE), entries(spark, d), "doc_id")


@query("RT8_hybrid_search", _HYBRID + "SELECT * FROM hy")
def rt8(spark, d):
    return hybrid(spark, d)


@query("RT20_revalidated", _HYBRID + "SELECT query_id, doc_id FROM hy WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0")
def rt20(spark, d):
    i = F.col("doc_id")
    live = B.documents(spark, d).filter("doc_id % 3 <> 0").select("doc_id", F.when(i % 7 == 0, 2).otherwise(1).alias("version"))
    return R.revalidated(hybrid(spark, d).withColumn("version", F.lit(1)), live, ["doc_id", "version"]).select("query_id", "doc_id")


@query("RT14_related", _OVER + "SELECT query_id, doc_id, kind, rank FROM (SELECT query_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'card' ELSE 'unit' END AS kind, row_number() OVER (PARTITION BY query_id, doc_id % 2 ORDER BY score DESC, doc_id) AS rank FROM over WHERE score >= CASE WHEN doc_id % 2 = 0 THEN 0.16 ELSE 0.12 END) WHERE rank <= CASE kind WHEN 'card' THEN 8 ELSE 12 END")
def rt14(spark, d):
    """What a plan is made with: the 8 cards related by 0.16 or more and the 12 units by 0.12 or more."""
    kind = F.when(F.col("doc_id") % 2 == 0, "card").otherwise("unit")
    is_card = F.col("kind") == "card"
    hits = overlap(spark, d).withColumn("kind", kind).filter(F.col("score") >= F.when(is_card, 0.16).otherwise(0.12))
    ranked = R.top(hits, ["query_id", "kind"], [F.col("score").desc(), "doc_id"], 12)
    return ranked.filter(F.col("rank") <= F.when(is_card, 8).otherwise(12)).select("query_id", "doc_id", "kind", "rank")


@query("RT33_mixed_search", _OVER + "SELECT query_id, kind, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id) AS rank FROM (SELECT query_id, CASE WHEN doc_id % 5 = 0 THEN 'card' ELSE 'document' END AS kind, doc_id AS id, score FROM over WHERE score >= 0.18)) WHERE rank <= 5")
def rt33(spark, d):
    hits = overlap(spark, d).withColumnRenamed("doc_id", "id")
    return R.mixed(hits.filter("id % 5 <> 0"), hits.filter("id % 5 = 0"))


_LIB = B.RV_SQL + """, cards AS (SELECT id, exercise % 3 = 0 AS favourite, unit % 4 AS review_count, exercise % 2 AS mastery, 'b' || exercise % 6 AS batch, event_type AS title, 'unit ' || unit AS summary FROM rv)
"""


def cards(spark, d):
    k = F.col("exercise")
    return B.review_events(spark, d).select("id", (k % 3 == 0).alias("favourite"), (F.col("unit") % 4).alias("review_count"), (k % 2).alias("mastery"), F.concat(F.lit("b"), (k % 6).cast("string")).alias("batch"), F.col("event_type").alias("title"), F.concat(F.lit("unit "), F.col("unit").cast("string")).alias("summary"))


@query("RT17_library_filter", _LIB + "SELECT id, favourite, review_count = 0 AND mastery = 0 AS is_new FROM cards WHERE batch = 'b2' AND contains(lower(title || ' ' || summary), 'click unit 2') AND (favourite OR (review_count = 0 AND mastery = 0) OR TRUE)")
def rt17(spark, d):
    c = cards(spark, d).filter("batch = 'b2'")
    return c.filter(F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit("click unit 2"))).select("id", "favourite", ((F.col("review_count") == 0) & (F.col("mastery") == 0)).alias("is_new"))


@query("RT18_rank_join", _OVER + f", rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM over WHERE score >= 0.18) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM rk WHERE doc_id IN (SELECT doc_id FROM ({_ENTRIES}) WHERE linked)")
def rt18(spark, d):
    """Filtered cards in the order of a search's ranking."""
    ranked = R.top(overlap(spark, d).filter(F.col("score") >= R.OVERLAP_LEAST), ["query_id"], [F.col("score").desc(), "doc_id"], 2**31 - 1)
    kept = ranked.join(entries(spark, d).filter("linked").select("doc_id"), "doc_id", "left_semi")
    return L.first_rows(kept, ["query_id"], ["rank"], 2**31 - 1, "position").select("query_id", "doc_id", "position")


@query("RT27_reference_numbers", B.RV_SQL + "SELECT learner, exercise, 'S' || n AS label FROM (SELECT learner, exercise, row_number() OVER (PARTITION BY learner ORDER BY min(ms), exercise) AS n FROM rv GROUP BY learner, exercise) WHERE n <= 20")
def rt27(spark, d):
    return R.numbered_references(B.review_events(spark, d), ["learner"], "exercise", "ms")


_PAIRS = """WITH g AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
p AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS user_turn, min(turn) FILTER (WHERE role = 'assistant') AS assistant_turn FROM g WHERE g > 0 GROUP BY conv_id, g HAVING count(*) FILTER (WHERE role = 'assistant') > 0),
z AS (SELECT p.*, length(u.text) + length(a.text) AS n FROM p JOIN conversations u ON u.conv_id = p.conv_id AND u.turn = user_turn JOIN conversations a ON a.conv_id = p.conv_id AND a.turn = assistant_turn)
"""


@query("CV3_budget_fit", _PAIRS + "SELECT conv_id, user_turn, back FROM (SELECT *, row_number() OVER w AS back, sum(n) OVER w AS used FROM z WINDOW w AS (PARTITION BY conv_id ORDER BY user_turn DESC)) WHERE back <= 3 AND used <= 500")
def cv3(spark, d):
    c = B.table(spark, d, "conversations")
    size = lambda t, n: c.select("conv_id", F.col("turn").alias(t), F.length("text").alias(n))
    pairs = V.turn_pairs(c).join(size("user_turn", "_u"), ["conv_id", "user_turn"]).join(size("assistant_turn", "_a"), ["conv_id", "assistant_turn"]).withColumn("n", F.col("_u") + F.col("_a"))
    return S.budget_fit(pairs, "n", 3, 500).select("conv_id", "user_turn", "back")
