"""Queries over the stored index of passages, and their SQL.

The passages are windows of 360 characters of whole documents under their source as heading. The
index is built, then a tenth of the documents is revised and some are removed, and the searches
read what is then live; the SQL works on the final texts alone, as a rebuild would.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import chunking as C
from lorecraft.operators import index as I
from lorecraft.operators import retrieval as R
from lorecraft.operators import structure as S
from lorecraft.plans.registry import Registry
from lorecraft.plans.retrieval import DENSE
from lorecraft.plans.texts import terms
from lorecraft.sources import commits
from lorecraft.sources.shared import fresh_path

query = Registry()


def passages(spark, d, docs):
    """Windows of docs(doc_id, text) with what the index asks for."""
    own = C.sliding_windows(docs, "doc_id", "text").join(S.linked(B.documents(spark, d).select("doc_id", "source"), B.table(spark, d, "labels"), "doc_id"), "doc_id")
    kind = F.when(F.col("doc_id") % 5 == 0, "card").otherwise("document")
    return own.select(F.col("doc_id").alias("owner"), F.col("start").alias("entry"), kind.alias("type"), "linked", F.col("source").alias("heading"), "text")


def revised(spark, d):
    """The path of an index after a revision of every tenth document and the removal of every seventeenth."""
    path, docs = fresh_path(spark, "index"), B.documents(spark, d).select("doc_id", "text")
    I.build(spark, path, passages(spark, d, docs))
    changed = docs.filter("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("Revised. "), "text"))
    I.update(spark, path, passages(spark, d, changed), docs.filter("doc_id % 17 = 0").select(F.col("doc_id").alias("owner")), "revision 1")
    return path


def live(spark, path):
    """Its entries."""
    return commits.read(spark, path, "entries", I.KEY)


def hits(spark, d, path=None):
    path = path or revised(spark, d)
    return I.overlaps(B.queries(spark, d), *[commits.every(spark, path, name) for name in ("entries", "postings")], holding=commits.holding(spark, path, I.KEY))


_HITS = f"""WITH docs AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN 'Revised. ' || text ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0 AND length(text) > 0),
w AS (SELECT doc_id AS owner, CASE WHEN doc_id % 5 = 0 THEN 'card' ELSE 'document' END AS type, source AS heading, s AS entry, source || chr(10) || substr(text, s + 1, 360) AS whole
  FROM (SELECT *, unnest(range(0, greatest(0, ceil((length(text) - 360) / 320.0)::INT) * 320 + 1, 320))::INT AS s FROM docs)),
q AS (SELECT item_id AS query_id, trim(lower(substr(text, 1, 80))) AS q, {terms("trim(substr(text, 1, 80))")} AS qt FROM benchmark),
e AS (SELECT *, lower(whole) AS norm, {terms('whole')} AS dt FROM w),
x AS (SELECT query_id, owner, entry, any_value(nq) AS nq, any_value(nd) AS nd, sum(CASE WHEN starts_with(term, 'synonym_') THEN 2 ELSE 1 END) AS hits
  FROM (SELECT query_id, len(qt) AS nq, unnest(qt) AS term FROM q) JOIN (SELECT owner, entry, len(dt) AS nd, unnest(dt) AS term FROM e) USING (term) GROUP BY ALL),
hits AS (SELECT x.query_id, x.owner, x.entry, type, heading, length(q) >= 2 AND contains(norm, q) AS exact,
  round(least(1.0, greatest(CASE WHEN length(q) >= 2 AND contains(norm, q) THEN 0.9 ELSE 0.0 END, hits / sqrt(nq * least(nd, nq * 4)))), 6) AS score FROM x JOIN q USING (query_id) JOIN e USING (owner, entry)),
good AS (SELECT * FROM hits WHERE score >= 0.18)
"""


@query("RT3_passages", _HITS + """SELECT query_id, owner, entry, heading, score, exact, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, owner ORDER BY score DESC, entry) AS rank FROM good) WHERE rank <= 5""")
def rt3_passages(spark, d):
    """The five best passages of each document for each query."""
    return I.within_documents(hits(spark, d)).select("query_id", "owner", "entry", "heading", "score", "exact", "rank")


@query("RT12_passages", _HITS + """SELECT query_id, owner, entry, heading, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, owner, entry) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, owner ORDER BY score DESC, owner, entry) AS g FROM good) WHERE g <= 2) WHERE rank <= 5""")
def rt12_passages(spark, d):
    """The five best passages of a query, two of a document at most."""
    return I.across_documents(hits(spark, d)).select("query_id", "owner", "entry", "heading", "score", "rank")


@query("RT8_passages", _HITS + f""", dn AS (SELECT b.item_id AS query_id, w.owner, w.entry, w.type, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS ds
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, w JOIN embeddings v ON v.vec_id = w.owner AND w.entry = 0 WHERE v.vec_id <> q.vec_id),
fu AS (SELECT query_id, owner, entry, type, round(sum(p), 6) AS score, max(ls) AS lexical_score, max(ds) AS dense_score FROM (
  SELECT query_id, owner, entry, type, 1.25 * (61 / 2.25) / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, owner, entry)) AS p, score AS ls, 0.0::DOUBLE AS ds FROM good
  UNION ALL SELECT query_id, owner, entry, type, (61 / 2.25) / (60 + row_number() OVER (PARTITION BY query_id ORDER BY ds DESC, owner, entry)), 0.0, ds FROM dn WHERE ds >= {DENSE}) GROUP BY ALL),
ca AS (SELECT *, row_number() OVER (PARTITION BY query_id, type, owner ORDER BY score DESC, lexical_score DESC, owner, entry) AS n FROM fu)
SELECT query_id, owner, entry, score, lexical_score, dense_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lexical_score DESC, owner, entry) AS rank
FROM ca WHERE n <= CASE type WHEN 'card' THEN 1 ELSE 2 END QUALIFY rank <= 5""")
def rt8_passages(spark, d):
    """Both branches over passages: overlap, and cosines of the passage that opens a document."""
    path = revised(spark, d)
    v = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    q = B.queries(spark, d).select("query_id").join(v.withColumnRenamed("vec_id", "query_id"), "query_id")
    opening = live(spark, path).filter("entry = 0").select("owner", "entry", "type")
    near = R.dense(q, opening.select("owner").join(v.withColumnRenamed("vec_id", "owner"), "owner"), "owner", DENSE).join(opening, "owner")
    return I.fused(hits(spark, d, path), near, DENSE)


_TEXT = "CASE WHEN doc_id % 10 = 0 THEN 'Revised. ' || coalesce(text, '') ELSE text END"


@query("CH7_live_passages", f"""SELECT doc_id AS owner, count(*) AS passages FROM (SELECT doc_id, unnest(range(0, greatest(0, ceil((length(t) - 360) / 320.0)::INT) * 320 + 1, 320)) FROM (SELECT doc_id, {_TEXT} AS t FROM documents WHERE doc_id % 17 <> 0) WHERE length(t) > 0) GROUP BY doc_id""")
def ch7_live(spark, d):
    """What is live in the index after the revision: one set of passages for each document that is left."""
    return live(spark, revised(spark, d)).groupBy("owner").agg(F.count("*").alias("passages"))
