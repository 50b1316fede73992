"""Lexical, BM25 and vector retrieval for batches of queries, with rank fusion and group caps.

Queries are a table of batch size; corpora and postings may be of any size. Postings meet
queries by an equi-join on the term, after an aggregation of both sides, and every top-k is a
row_number filter, which Spark pushes below the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorecraft.functions import text as X
from lorecraft.sources.shared import written

K1, B = 1.2, 0.75
OVERLAP_LEAST, DENSE_LEAST = 0.18, 0.44
RRF_K, LEXICAL_WEIGHT, DENSE_WEIGHT = 60, 1.25, 1.0


def top(rows: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def term_sets(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, n_terms): the distinct terms of each row."""
    told = rows.select(key, X.terms(text).alias("_t"))
    # counted before: else each row of a term would carry the whole set
    return told.withColumn("n_terms", F.size("_t")).select(key, "n_terms", each("_t"))


def each(words: str) -> Column:
    """A row for each of an array of words.

    The outer form, as the plain one gets a filter that works out the words once more for each of
    its tests; the row of an empty array has a null word, which no join meets.
    """
    return F.explode_outer(words).alias("term")


#: Queries whose words can all be parts of longer ones, which are looked for in every text: so many of them, more or less, in one broadcast.
MAX_LOOSE = 10_000


def met_by(words: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """words(term) joined with the terms of queries, where they lie unless the batch is large."""
    return words.join(F.broadcast(terms) if queries.count() <= MAX_LOOSE else terms, "term")


def overlap(queries: DataFrame, corpus: DataFrame, id_col: str, text: Column, query: Column, least: float = 0.0) -> DataFrame:
    """(query_id, id, score, matched, exact) of all pairs with a common term or an exact phrase that score `least` or more.

    hits / sqrt(nq * min(nd, 4 nq)), where a synonym tag counts twice; 0.9 at least where the
    whole query occurs; 1 at most. A text that holds the whole query has all its inner terms,
    those that are not cut off at either end; so texts are only read again for pairs that match
    that many. Queries without inner terms are held against all texts, in
    blocks of MAX_LOOSE.
    """
    q, c = term_sets(queries, "query_id", query), term_sets(corpus, id_col, text)
    needle = queries.select("query_id", F.trim(query).alias("_q"), X.terms(query).alias("_t"))
    inner = X.terms(F.regexp_replace("_q", r"^[a-z0-9_]+|[a-z0-9_]+$", " "))
    needle = needle.select("query_id", "_q", F.size("_t").alias("nq"), F.size(inner).alias("inner")).filter(F.length("_q") >= 2)
    weight = F.when(F.startswith("term", F.lit("synonym_")), 2).otherwise(1)
    both = met_by(c.withColumnRenamed("n_terms", "nd"), queries, q.withColumnRenamed("n_terms", "nq"))
    hits = both.groupBy("query_id", id_col, "nq", "nd").agg(F.sum(weight).alias("hits"), F.count("*").alias("matched"))
    hits = hits.join(needle.select("query_id", "_q", "inner"), "query_id", "left").withColumn("full", F.coalesce(F.col("matched") >= F.col("inner"), F.lit(False)))
    raw = F.col("hits") / F.sqrt(F.col("nq") * F.least(F.col("nd"), F.col("nq") * 4))
    # what a phrase may still lift stays; written, as all that follows would cut the texts into words again
    hits = written(hits.filter(F.col("full") | (raw >= least - 1e-6)).drop("_q", "inner"), "pairs")
    texts = corpus.select(id_col, text.alias("_text"))
    found = hits.filter("full").join(needle.select("query_id", "_q"), "query_id").join(texts, id_col).withColumn("exact", F.contains("_text", F.col("_q"))).drop("_text", "_q")
    hits = found.unionByName(hits.filter("NOT full").withColumn("exact", F.lit(False)))
    score = F.least(F.lit(1.0), F.greatest(F.when(F.col("exact"), 0.9).otherwise(0.0), raw))
    told = hits.select("query_id", id_col, F.round(score, 6).alias("score"), "matched", "exact").filter(F.col("score") >= least)
    loose = needle.filter("inner = 0 AND nq > 0").select("query_id", "_q")
    blocks = -(-loose.count() // MAX_LOOSE)
    if not blocks:
        return told
    texts = texts.filter(F.size(X.terms(F.col("_text"))) > 0)
    part = lambda k: loose.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
    exact = reduce(DataFrame.unionByName, [texts.join(F.broadcast(part(k)), F.contains("_text", F.col("_q"))).select("query_id", id_col) for k in range(blocks)])
    alone = exact.join(told.select("query_id", id_col), ["query_id", id_col], "left_anti")
    return told.unionByName(alone.select("query_id", id_col, F.lit(0.9).alias("score"), F.lit(0).cast("long").alias("matched"), F.lit(True).alias("exact")))


def evidence_status(queries: DataFrame, hits: DataFrame, documents: DataFrame, least: float = OVERLAP_LEAST) -> DataFrame:
    """(query_id, status): whether any hit reaches the threshold, else whether there is any document."""
    found = hits.filter(F.col("score") >= least).select("query_id").distinct().withColumn("_hit", F.lit(True))
    some = documents.limit(1).agg((F.count("*") > 0).alias("_some"))  # one row
    status = F.when(F.col("_hit"), "related_found").when(F.col("_some"), "no_related_sources").otherwise("no_personal_sources")
    return queries.join(found, "query_id", "left").crossJoin(F.broadcast(some)).select("query_id", status.alias("status"))


def postings(corpus: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf)."""
    return corpus.select(id_col, X.tokens(text).alias("_t")).select(id_col, each("_t")).filter("term IS NOT NULL").groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def bm25_statistics(corpus: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings(id, term, tf), frequencies(term, df) and totals(n, avg_len) over all eligible rows, empty ones too."""
    p = postings(corpus, id_col, text)
    sizes = corpus.select(id_col, F.size(X.tokens(text)).alias("len"))
    return p, p.groupBy("term").agg(F.count("*").alias("df")), sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def bm25(queries: DataFrame, corpus: DataFrame, id_col: str, text: Column, query: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score): BM25 over distinct query terms, of pairs that score above 0.

    Only postings of terms that some query has are counted and joined: terms of the batch are
    a join before anything is aggregated.
    """
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 is 0 or more and b from 0 to 1")
    q = queries.select("query_id", F.explode(F.array_distinct(X.tokens(query))).alias("term"))
    tokens = corpus.select(id_col, X.tokens(text).alias("_t")).withColumn("len", F.size("_t"))
    totals = tokens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    # written, as both sides of what follows would cut the texts into words again
    tf = written(met_by(tokens.select(id_col, "len", each("_t")), queries, q.select("term").distinct()).groupBy(id_col, "len", "term").agg(F.count("*").alias("tf")), "postings")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    both = q.join(df, "term").join(tf, "term").crossJoin(F.broadcast(totals))  # totals is one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return both.groupBy("query_id", id_col).agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")


def dense(queries: DataFrame, vectors: DataFrame, id_col: str, least: float = DENSE_LEAST, query_block: int = 512, vector_block: int = 8192) -> DataFrame:
    """(query_id, id, score): exact cosine of a query set to all vectors, in blocks of both.

    Every block of queries meets every block of vectors in one task as a product of two
    matrices, so neither side is broadcast and a task holds two blocks. A zero norm or an
    unequal length scores 0. A query doesn't find itself.
    """
    qs = max(1, -(-queries.count() // query_block))
    vs = max(1, -(-vectors.count() // vector_block))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", F.col("embedding").alias("e"), block("query_id", qs).alias("qb")).withColumn("vb", every(vs))
    v = vectors.select(F.col(id_col).alias("id"), F.col("embedding").alias("e"), block(id_col, vs).alias("vb")).withColumn("qb", every(qs))

    def scores(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for n in {len(x) for x in q["e"] if x is not None and len(x)}:
            qn, vn = ([x is not None and len(x) == n for x in side["e"]] for side in (q, v))
            if not any(vn):
                continue
            a, b = (np.array(side.loc[own, "e"].tolist(), np.float64) for side, own in ((q, qn), (v, vn)))
            norm = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
            s = np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0).round(6)
            i, j = np.nonzero(s >= least)
            parts.append(pd.DataFrame({"query_id": q.loc[qn, "query_id"].to_numpy()[i], "id": v.loc[vn, "id"].to_numpy()[j], "score": s[i, j]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "id": [], "score": []})

    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    told = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(scores, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return told.filter("query_id <> id").withColumnRenamed("id", id_col)


def fused(lexical: DataFrame, dense_: DataFrame, id_col: str) -> DataFrame:
    """(query_id, id, score, lexical_score, dense_score): weighted reciprocal ranks, scaled to 1 at most."""
    ranked = lambda d: d.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)))
    scale = (RRF_K + 1) / (LEXICAL_WEIGHT + DENSE_WEIGHT)
    part = lambda d, w, a, b: ranked(d).select("query_id", id_col, (w * scale / (RRF_K + F.col("_r"))).alias("_p"), a.alias("ls"), b.alias("ds"))
    none = F.lit(None).cast("double")
    both = part(lexical, LEXICAL_WEIGHT, F.col("score"), none).unionByName(part(dense_, DENSE_WEIGHT, none, F.col("score")))
    return both.groupBy("query_id", id_col).agg(F.round(F.sum("_p"), 6).alias("score"), F.max("ls").alias("lexical_score"), F.max("ds").alias("dense_score"))


def group_capped(hits: DataFrame, group: str, cap: int, limit: int, order: list) -> DataFrame:
    """At most cap hits of a group in rank order, then limit of each query."""
    capped = top(hits, ["query_id", group], order, cap, "_in_group").drop("_in_group")
    return top(capped, ["query_id"], order, limit)


def reranked(hits: DataFrame, scores: DataFrame, id_col: str, first: int = 10) -> DataFrame:
    """The first hits of each query in the order of an outside score, ties by the score they had."""
    told = hits.filter(F.col("rank") <= first).join(scores, ["query_id", id_col], "left").withColumn("outside", F.coalesce("outside", F.lit(0.0)))
    return told.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("outside").desc(), F.col("score").desc(), id_col)))


def missing_vectors(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """entries(id, model, text) without a valid row of cache(id, model, text, embedding)."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = cache.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return entries.join(valid.select("id", "model", "text"), ["id", "model", "text"], "left_anti")


def stale_vectors(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of cache whose entry is gone or has another model or text."""
    return cache.join(entries.select("id", "model", "text"), ["id", "model", "text"], "left_anti")


def resolved_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations(citation_id, doc_id, version, start, end, quote, saved) with a status.

    available: documents(doc_id, version, content) holds the quote there in this version;
    excerpt_only: the document is gone but the excerpt was saved; stale: it says something else.
    """
    told = citations.join(documents.withColumnRenamed("version", "_v"), "doc_id", "left")
    same = (F.col("_v") == F.col("version")) & (F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote"))
    status = F.when(same, "available").when(F.col("content").isNull() & F.col("saved"), "excerpt_only").when(F.col("content").isNull(), "missing").otherwise("stale")
    return told.select("citation_id", "doc_id", status.alias("status"))


def nth_occurrence(text: Column, needle: Column, k: int) -> Column:
    """Place (from 0) of the k-th occurrence, counted with overlaps; -1 where there are fewer."""
    places = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda at, i: F.when(at < 0, at).otherwise(F.coalesce(F.nullif(F.call_function("locate", needle, text, at + 1), F.lit(0)), F.lit(-1))))
    return F.when(places < 0, -1).otherwise(places - 1)


def hybrid(lexical: DataFrame, dense_: DataFrame, entries: DataFrame, id_col: str, limit: int = 5, caps: tuple[int, int] = (1, 2)) -> DataFrame:
    """(query_id, id, score, lexical_score, dense_score, rank): fused ranks, capped for each card and each document.

    entries(id, type, owner): a card is shown caps[0] times, a document caps[1] times; the rest
    moves up until limit. Both branches are cut by their thresholds before.
    """
    told = fused(lexical, dense_, id_col).join(entries.select(id_col, "type", "owner"), id_col)
    order = [F.col("score").desc(), F.col(id_col)]
    place = F.row_number().over(Window.partitionBy("query_id", "type", "owner").orderBy(*order))
    capped = told.withColumn("_n", place).filter(F.col("_n") <= F.when(F.col("type") == "card", caps[0]).otherwise(caps[1]))
    return top(capped, ["query_id"], order, limit).drop("_n", "type", "owner")


def revalidated(hits: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Hits whose entry is still there as it was when it was scored: same id, version and text."""
    return hits.join(live.select(*keys), keys, "left_semi")


def numbered_references(references: DataFrame, by: list[str], key: str, order: str, most: int = 20) -> DataFrame:
    """Distinct references of each turn as S1 to Sn, in order of their first use."""
    first = references.groupBy(*by, key).agg(F.min(order).alias("_first"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy("_first", key))
    return first.withColumn("_n", n).filter(F.col("_n") <= most).select(*by, key, F.concat(F.lit("S"), F.col("_n").cast("string")).alias("label"))


def mixed(evidence: DataFrame, cards: DataFrame, least: float = OVERLAP_LEAST, limit: int = 5) -> DataFrame:
    """(query_id, kind, id, score, rank): documents and cards of one query together, best first."""
    part = lambda d, kind: d.filter(F.col("score") >= least).select("query_id", F.lit(kind).alias("kind"), "id", "score")
    return top(part(evidence, "document").unionByName(part(cards, "card")), ["query_id"], [F.col("score").desc(), "kind", "id"], limit)
