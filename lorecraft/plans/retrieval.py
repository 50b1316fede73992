"""Retrieval queries: benchmark items search the documents; vectors search vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.functions import text as X
from lorecraft.operators import retrieval as R
from lorecraft.plans.registry import Registry
from lorecraft.plans.texts import terms, tok

query = Registry()
DENSE = 0.25


def text():
    return X.normalize_text(F.col("text"))


def searched():
    return X.normalize_text(F.col("query"))


_OVER = f"""WITH q AS (SELECT item_id AS query_id, lower(substr(text, 1, 80)) AS q, {terms('substr(text, 1, 80)')} AS qt FROM benchmark),
d AS (SELECT doc_id, source, lower(text) AS t, {terms('text')} AS dt FROM documents),
qx AS (SELECT query_id, len(qt) AS nq, unnest(qt) AS term FROM q), dx AS (SELECT doc_id, len(dt) AS nd, unnest(dt) AS term FROM d),
hits AS (SELECT query_id, doc_id, nq, nd, sum(CASE WHEN starts_with(term, 'synonym_') THEN 2 ELSE 1 END) AS hits, count(*) AS matched FROM qx JOIN dx USING (term) GROUP BY ALL),
over AS (SELECT h.query_id, h.doc_id, source, round(least(1.0, greatest(CASE WHEN length(trim(q)) >= 2 AND contains(t, trim(q)) THEN 0.9 ELSE 0.0 END, hits / sqrt(nq * least(nd, nq * 4)))), 6) AS score, matched, length(trim(q)) >= 2 AND contains(t, trim(q)) AS exact
  FROM hits h JOIN q ON q.query_id = h.query_id JOIN d ON d.doc_id = h.doc_id)
"""
_BM = f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({tok('substr(text, 1, 80)')})) AS term FROM benchmark),
t AS (SELECT doc_id, {tok('text')} AS l FROM documents), tot AS (SELECT count(*) AS n, avg(len(l)) AS avg_len FROM t),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(l) AS len, unnest(l) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term), tot GROUP BY ALL HAVING round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) > 0)
"""
_DENSE = f"""WITH dn AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v
  WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) >= {DENSE})
"""


def overlap(spark, d, least=0.0):
    return R.overlap(B.queries(spark, d), B.documents(spark, d), "doc_id", text(), searched(), least)


def bm25(spark, d):
    return R.bm25(B.queries(spark, d), B.documents(spark, d), "doc_id", text(), searched())


def dense(spark, d):
    v = B.table(spark, d, "embeddings")
    return R.dense(v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, "vec_id", DENSE)


@query("RT1_lexical_overlap", _OVER + "SELECT query_id, doc_id, score, exact FROM over WHERE score >= 0.18")
def rt1(spark, d):
    return overlap(spark, d, R.OVERLAP_LEAST).select("query_id", "doc_id", "score", "exact")


@query("RT2_score_explanation", _OVER + "SELECT query_id, sum(matched)::BIGINT AS matched, count(*) FILTER (WHERE exact) AS exact_hits FROM over GROUP BY query_id")
def rt2(spark, d):
    return overlap(spark, d).groupBy("query_id").agg(F.sum("matched").alias("matched"), F.count_if("exact").alias("exact_hits"))


@query("RT3_lexical_topk", _OVER + "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM over WHERE score >= 0.18) WHERE rank <= 5")
def rt3(spark, d):
    hits = overlap(spark, d, R.OVERLAP_LEAST).select("query_id", "doc_id", "score")
    return R.top(hits, ["query_id"], [F.col("score").desc(), "doc_id"], 5)


@query("RT4_bm25_statistics", f"WITH t AS (SELECT doc_id, {tok('text')} AS l FROM documents), z AS (SELECT count(*) AS n, round(avg(len(l)), 6) AS avg_len FROM t) SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences, any_value(n) AS n, any_value(avg_len) AS avg_len FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS term FROM t) GROUP BY ALL), z GROUP BY term")
def rt4(spark, d):
    p, _, totals = R.bm25_statistics(B.documents(spark, d), "doc_id", text())
    own = p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))
    return own.crossJoin(F.broadcast(totals.select("n", F.round("avg_len", 6).alias("avg_len"))))  # totals is one row


@query("RT5_bm25_rank", _BM + "SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 5")
def rt5(spark, d):
    return R.top(bm25(spark, d), ["query_id"], [F.col("score").desc(), "doc_id"], 5)


@query("RT6_dense_scan", _DENSE + "SELECT query_id, vec_id, score FROM dn")
def rt6(spark, d):
    return dense(spark, d)


_FUSE = """, lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM lx), br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm),
fu AS (SELECT query_id, doc_id, round(sum(p), 6) AS score, max(ls) AS lexical_score, max(ds) AS dense_score FROM (SELECT query_id, doc_id, 1.25::DOUBLE * (61 / 2.25::DOUBLE) / (60 + r) AS p, score AS ls, NULL::DOUBLE AS ds FROM lr UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE * (61 / 2.25::DOUBLE) / (60 + r), NULL, score FROM br) GROUP BY ALL)
"""
_BOTH = _OVER + ", lx AS (SELECT query_id, doc_id, score FROM over WHERE score >= 0.18), " + _BM.removeprefix("WITH ").replace("q AS (", "bq AS (", 1).replace("FROM q JOIN df", "FROM bq JOIN df") + _FUSE


@query("RT7_rank_fusion", _BOTH + "SELECT * FROM fu")
def rt7(spark, d):
    return R.fused(overlap(spark, d, R.OVERLAP_LEAST), bm25(spark, d), "doc_id")


@query("RT9_group_caps", _BOTH + """SELECT query_id, doc_id, source, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT f.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, f.doc_id) AS g FROM fu f JOIN documents d ON d.doc_id = f.doc_id) WHERE g <= 2) WHERE rank <= 5""")
def rt9(spark, d):
    hits = rt7(spark, d).join(B.documents(spark, d).select("doc_id", "source"), "doc_id")
    return R.group_capped(hits, "source", 2, 5, [F.col("score").desc(), "doc_id"]).select("query_id", "doc_id", "source", "score", "rank")


@query("RT10_gated_fusion", _BOTH + "SELECT b.query_id, b.doc_id, b.score FROM bm b JOIN lx ON lx.query_id = b.query_id AND lx.doc_id = b.doc_id")
def rt10(spark, d):
    gate = overlap(spark, d, R.OVERLAP_LEAST).select("query_id", "doc_id")
    return bm25(spark, d).join(gate, ["query_id", "doc_id"]).select("query_id", "doc_id", "score")


@query("RT11_rerank", _BM + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)
SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY (doc_id * 7 % 10) / 10.0 DESC, score DESC, doc_id) AS new_rank FROM r WHERE rank <= 10""")
def rt11(spark, d):
    hits = R.top(bm25(spark, d), ["query_id"], [F.col("score").desc(), "doc_id"], 10)
    outside = hits.select("query_id", "doc_id", ((F.col("doc_id") * 7 % 10) / 10).alias("outside"))
    return R.reranked(hits, outside, "doc_id").select("query_id", "doc_id", "rank", "new_rank")


@query("RT12_two_level_topk", _OVER + """, g AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS g, count(*) OVER (PARTITION BY query_id) AS candidates FROM over WHERE score >= 0.18)
SELECT query_id, doc_id, source, rank, candidates FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g WHERE g <= 2) WHERE rank <= 5""")
def rt12(spark, d):
    """At most 2 of a document's source, then 5 of a query, with the number of candidates there were."""
    hits = overlap(spark, d, R.OVERLAP_LEAST).join(B.documents(spark, d).select("doc_id", "source"), "doc_id")
    counts = hits.groupBy("query_id").agg(F.count("*").alias("candidates"))
    return R.group_capped(hits, "source", 2, 5, [F.col("score").desc(), "doc_id"]).join(counts, "query_id").select("query_id", "doc_id", "source", "rank", "candidates")


@query("RT13_similar_check", _OVER + "SELECT query_id, doc_id, rank, round(100 * score)::BIGINT AS percent FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM over WHERE score >= 0.72) WHERE rank <= 3")
def rt13(spark, d):
    hits = R.top(overlap(spark, d, 0.72), ["query_id"], [F.col("score").desc(), "doc_id"], 3)
    return hits.select("query_id", "doc_id", "rank", F.round(100 * F.col("score")).cast("long").alias("percent"))


@query("RT15_evidence_status", _OVER + """SELECT b.item_id AS query_id, CASE WHEN max(score) >= 0.18 THEN 'related_found' WHEN (SELECT count(*) FROM documents) > 0 THEN 'no_related_sources' ELSE 'no_personal_sources' END AS status FROM benchmark b LEFT JOIN over ON over.query_id = b.item_id GROUP BY b.item_id""")
def rt15(spark, d):
    return R.evidence_status(B.queries(spark, d), overlap(spark, d), B.documents(spark, d))


@query("RT16_linked_only", _OVER + "SELECT query_id, doc_id, score FROM over WHERE score >= 0.18 AND doc_id IN (SELECT doc_id FROM labels) AND doc_id <> query_id")
def rt16(spark, d):
    hits = overlap(spark, d, R.OVERLAP_LEAST)
    return hits.join(B.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").filter("doc_id <> query_id").select("query_id", "doc_id", "score")


def _entries(spark, d):
    return B.documents(spark, d).select(F.col("doc_id").alias("id"), F.lit("m1").alias("model"), F.sha2(F.col("text"), 256).alias("text"))


def _cache(spark, d):
    v = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    own = B.documents(spark, d).join(v, F.col("doc_id") == F.col("vec_id"))
    digest = F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.sha2(F.col("text"), 256))
    return own.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "m0").otherwise("m1").alias("model"), digest.alias("text"), "embedding")


_CACHE = """WITH en AS (SELECT doc_id AS id, 'm1' AS model, sha256(text) AS text FROM documents), ca AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'm0' ELSE 'm1' END AS model, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS text FROM documents JOIN embeddings ON vec_id = doc_id)
"""


@query("RT21_missing_vectors", _CACHE + "SELECT id FROM en WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.id = en.id AND ca.model = en.model AND ca.text = en.text)")
def rt21(spark, d):
    return R.missing_vectors(_entries(spark, d), _cache(spark, d)).select("id")


@query("RT22_stale_vectors", _CACHE + "SELECT id, model FROM ca WHERE NOT EXISTS (SELECT 1 FROM en WHERE ca.id = en.id AND ca.model = en.model AND ca.text = en.text)")
def rt22(spark, d):
    return R.stale_vectors(_cache(spark, d), _entries(spark, d)).select("id", "model")


@query("RT23_vector_sanity", "SELECT label, bool_and(len(embedding) = 64) AS valid, CASE WHEN bool_and(len(embedding) = 64) THEN 'local-semantic' ELSE 'lexical-fallback' END AS strategy FROM embeddings GROUP BY label")
def rt23(spark, d):
    good = (F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return B.table(spark, d, "embeddings").groupBy("label").agg(F.bool_and(good).alias("valid")).withColumn("strategy", F.when(F.col("valid"), "local-semantic").otherwise("lexical-fallback"))


@query("RT24_citation_resolve", """WITH c AS (SELECT doc_id * 2 AS citation_id, doc_id + CASE WHEN doc_id % 6 = 0 THEN 10000000 ELSE 0 END AS doc_id, 1 + (doc_id % 4 = 0)::INT AS version, 10 AS s, 40 AS e, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE substr(text, 11, 30) END AS quote, doc_id % 12 = 0 AS saved FROM documents)
SELECT citation_id, c.doc_id, CASE WHEN c.version = 1 AND substr(d.text, 11, 30) = quote THEN 'available' WHEN d.text IS NULL AND saved THEN 'excerpt_only' WHEN d.text IS NULL THEN 'missing' ELSE 'stale' END AS status FROM c LEFT JOIN documents d ON d.doc_id = c.doc_id""")
def rt24(spark, d):
    docs = B.documents(spark, d)
    i = F.col("doc_id")
    quote = F.when(i % 9 == 0, "x").otherwise(F.substring("text", 11, 30))
    citations = docs.select(
        (i * 2).alias("citation_id"), (i + F.when(i % 6 == 0, 10000000).otherwise(0)).alias("doc_id"), (1 + (i % 4 == 0).cast("int")).alias("version"),
        F.lit(10).alias("start"), F.lit(40).alias("end"), quote.alias("quote"), (i % 12 == 0).alias("saved"),
    )
    return R.resolved_citations(citations, docs.select("doc_id", F.lit(1).alias("version"), F.col("text").alias("content")))


@query("RT26_nth_occurrence", """SELECT doc_id, CASE WHEN a = 0 OR b = 0 THEN -1 WHEN c = 0 THEN -1 ELSE a + b + c - 1 END AS place FROM (SELECT *, CASE WHEN b > 0 THEN instr(substr(t, (a + b)::INT + 1), 'en') ELSE 0 END AS c FROM (SELECT *, CASE WHEN a > 0 THEN instr(substr(t, a::INT + 1), 'en') ELSE 0 END AS b FROM (SELECT doc_id, text AS t, instr(text, 'en') AS a FROM documents)))""")
def rt26(spark, d):
    return B.documents(spark, d).select("doc_id", R.nth_occurrence(F.col("text"), F.lit("en"), 3).cast("long").alias("place"))


@query("RT29_document_list", "SELECT d.doc_id, count(DISTINCT l.quality * 2 + l.toxic) AS linked FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id")
def rt29(spark, d):
    labels = B.table(spark, d, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("card"))
    return B.documents(spark, d).select("doc_id").join(labels, "doc_id", "left").groupBy("doc_id").agg(F.count_distinct("card").alias("linked"))


@query("RT32_same_document", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text), lang HAVING count(*) > 1")
def rt32(spark, d):
    return B.documents(spark, d).groupBy(F.sha2(F.col("text"), 256).alias("h"), "lang").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1").select("doc_id", "copies")


_EV = _BM + """, rk AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 3),
rel AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE contains(documents.text, substr(benchmark.text, 1, 80))),
m AS (SELECT rel.query_id, count(*) AS labels, count(rank) AS found, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM rel LEFT JOIN rk ON rk.query_id = rel.query_id AND rk.doc_id = rel.doc_id GROUP BY rel.query_id),
ev AS (SELECT item_id AS query_id, labels, CASE WHEN labels IS NOT NULL THEN (coalesce(first = 1, FALSE))::INT END AS hit_at_1, round(found / labels, 6) AS recall, CASE WHEN labels IS NOT NULL THEN round(coalesce(1 / first, 0), 6) END AS mrr,
  round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 4) r(i) WHERE i <= labels), 6) AS ndcg FROM benchmark LEFT JOIN m ON m.query_id = item_id)
"""


def evaluated(spark, d, k=3):
    """Scores of the BM25 ranking against documents that hold the query."""
    from pyspark.sql import Window  # noqa: F401

    ranked = R.top(bm25(spark, d), ["query_id"], [F.col("score").desc(), "doc_id"], k)
    q = B.queries(spark, d)
    # a document that holds the query shares its terms, so relevance is a filter on pairs that met
    met = R.overlap(q.select("query_id", "query"), B.documents(spark, d), "doc_id", F.col("text"), F.col("query")).filter("exact").select("query_id", "doc_id")
    m = met.join(ranked, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("labels"), F.count("rank").alias("found"), F.min("rank").alias("first"), F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("labels"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    told = q.select("query_id").join(m, "query_id", "left")
    has = F.col("labels").isNotNull()
    return told.select(
        "query_id", "labels", F.when(has, F.coalesce((F.col("first") == 1).cast("int"), F.lit(0))).alias("hit_at_1"), F.round(F.col("found") / F.col("labels"), 6).alias("recall"),
        F.when(has, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("mrr"), F.when(has, F.round(F.col("dcg") / ideal, 6)).alias("ndcg"),
    )


@query("EV1_ranking_scores", _EV + "SELECT * FROM ev")
def ev1(spark, d):
    return evaluated(spark, d)


@query("EV2_ranking_summary", _EV + "SELECT labels IS NOT NULL AS positive, count(*) AS queries, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ev GROUP BY 1")
def ev2(spark, d):
    means = [F.round(F.avg(c), 6).alias(c) for c in ("hit_at_1", "recall", "mrr", "ndcg")]
    return evaluated(spark, d).groupBy(F.col("labels").isNotNull().alias("positive")).agg(F.count("*").alias("queries"), *means)
