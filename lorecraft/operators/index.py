"""A stored index of passages, and searches that read it instead of texts.

Passages are (owner, entry, type, linked, heading, text); an owner is a document or card with all
its passages. The index is two tables under commits by owner: `entries`, a row for each passage
with its distinct terms and normalised text, and `postings`, a row for each term of a passage,
which lie beside each other, so that all but the terms takes little room. A changed owner is
indexed again and a removed one is a tombstone; no other text is read. Blocks of queries that have
a posting meet the terms of entries where those lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from lorecraft.functions import text as X
from lorecraft.operators import retrieval as R
from lorecraft.sources import commits

KEY = ["owner"]
HEADING_BREAK = "\n"
#: Characters of a query that a search reads, as the rule of searches has it.
QUERY = 1000
#: Queries, more or less, that go to the entries at once, and entries that a task holds against them at once.
QUERIES, ROWS = 2000, 1000


def indexed(passages: DataFrame) -> dict[str, DataFrame]:
    """entries and postings of passages."""
    whole = X.normalize_text(F.concat(F.coalesce("heading", F.lit("")), F.lit(HEADING_BREAK), F.coalesce("text", F.lit(""))))
    told = passages.withColumn("norm", whole)
    entries = told.select("owner", "entry", "type", "linked", "heading", "text", "norm", X.terms(F.col("norm")).alias("terms"))
    return {"entries": entries, "postings": posted(entries)}


def posted(entries: DataFrame) -> DataFrame:
    """postings of entries."""
    return entries.withColumn("n_terms", F.size("terms")).select("owner", "entry", "n_terms", F.explode("terms").alias("term"))


def staged(passages: DataFrame) -> dict:
    """What a commit writes of passages: entries, and postings of those that are written."""
    return indexed(passages) | {"postings": lambda made: posted(made["entries"])}


def build(spark: SparkSession, path: str, passages: DataFrame, change: str = "build") -> int:
    """The first version of an index."""
    return commits.commit(spark, path, change, staged(passages), passages.select(*KEY).distinct().withColumn("deleted", F.lit(False)))


def update(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame, change: str) -> int:
    """A version in which the owners of `changed` have these passages alone and those of `removed` none.

    An owner in both is removed. A change that was made under this name is not made again.
    """
    kept = changed.join(removed.select(*KEY), KEY, "left_anti")
    keys = kept.select(*KEY).distinct().withColumn("deleted", F.lit(False)).unionByName(removed.select(*KEY).distinct().withColumn("deleted", F.lit(True)))
    return commits.commit(spark, path, change, staged(kept), keys)


def wanted(queries: DataFrame, query: Column | None = None) -> DataFrame:
    """(query_id, q, terms, inner): the normalised, trimmed query of 1000 characters at most, its terms and those that no longer word can hide.

    Inner terms are those that are not cut off at either end: a passage that holds the whole
    query has them all.
    """
    text = F.substring(F.trim(X.normalize_text(F.col("query") if query is None else query)), 1, QUERY)
    told = queries.select("query_id", text.alias("q")).withColumn("terms", X.terms(F.col("q")))
    inner = F.filter(X.terms(F.regexp_replace("q", r"^[a-z0-9_]+|[a-z0-9_]+$", " ")), lambda t: ~F.startswith(t, F.lit("synonym_")))
    return told.filter(F.size("terms") > 0).withColumn("inner", inner)


def overlaps(queries: DataFrame, entries: DataFrame, postings: DataFrame, least: float = R.OVERLAP_LEAST, holding: DataFrame | None = None) -> DataFrame:
    """(query_id, owner, entry, type, linked, heading, score, exact, matched array): all passages that score `least` or more.

    The score is that of term overlap, 0.9 at least for an exact phrase of two characters or
    more. Blocks of some QUERIES that have a posting go to the entries, whose terms are held
    against all of a block at once, where they lie: neither texts nor pairs are shuffled. Texts
    are only read for pairs that share all inner terms of a query, which an exact phrase does.

    With holding(owner, _version), entries and postings may be of any version; hits of entries
    that are no more go at the end, when they carry no text. Queries whose id repeats are one.
    Null and blank queries and passages match nothing.
    """
    own = wanted(queries.dropDuplicates(["query_id"]))
    blocks = max(1, -(-own.count() // QUERIES))
    parts = [own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else own for k in range(blocks)]
    hits = reduce(DataFrame.unionByName, [searched(part, entries, postings, least) for part in parts])
    if holding is not None:
        hits = hits.join(holding, [*KEY, "_version"], "left_semi")
    return hits.select("query_id", "owner", "entry", "type", "linked", "heading", "score", "exact", "matched")


def searched(own: DataFrame, entries: DataFrame, postings: DataFrame, least: float) -> DataFrame:
    """The hits of a block of wanted queries."""
    terms = own.select(F.explode("terms").alias("term")).distinct()
    there = {r.term for r in postings.join(F.broadcast(terms), "term", "left_semi").select("term").distinct().collect()}
    # a query without inner terms may lie inside longer words
    block = [r for r in own.select("query_id", "q", "terms", "inner").collect() if not r.inner or there.intersection(r.terms)]
    spots = {t: k for k, t in enumerate(sorted(there))}
    pairs = sorted((spots[t], k, t in r.inner) for k, r in enumerate(block) for t in r.terms if t in spots)
    spot, query, is_inner = (np.array(c, np.int64) for c in (zip(*pairs) if pairs else ((), (), ())))
    starts = np.searchsorted(spot, np.arange(len(spots) + 1))
    weights = np.array([2 if t.startswith("synonym_") else 1 for t in sorted(there)], np.int64)
    texts, sizes, inner = [r.q for r in block], np.array([len(r.terms) for r in block], np.int64), np.array([len(set(r.inner)) for r in block], np.int64)
    phrases = np.array([len(q) >= 2 for q in texts], bool)
    told = [c for c in ("owner", "entry", "type", "linked", "heading", "_version") if c in entries.columns]
    ids = own.schema["query_id"].dataType
    shape = StructType([*[StructField(c, entries.schema[c].dataType) for c in told], StructField("query_id", ids), *[StructField(c, LongType()) for c in ("nq", "nd", "hits")], StructField("exact", BooleanType()), StructField("matched", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, names, queries_ = pa.array(list(spots), pa.string()), [r.terms for r in block], pa.array([r.query_id for r in block], to_arrow_type(ids))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                found, norm = part.column("terms"), part.column("norm")
                n = np.asarray(pc.fill_null(pc.list_value_length(found), 0)).astype(np.int64)
                code = np.asarray(pc.fill_null(pc.index_in(found.flatten(), vocabulary), -1)).astype(np.int64)
                row, code = np.repeat(np.arange(len(part)), n)[code >= 0], code[code >= 0]
                each = starts[code + 1] - starts[code]
                place = np.arange(each.sum()) + np.repeat(starts[code] - np.r_[0, np.cumsum(each)[:-1]][: len(each)], each)
                cell = np.repeat(row, each) * len(block) + query[place]
                count = lambda w: np.bincount(cell, w, len(part) * len(block)).reshape(len(part), len(block))  # noqa: B023, E731
                hits, full = count(weights[spot[place]]), (count(is_inner[place]) >= inner) & phrases & (n > 0)[:, None]
                exact = np.zeros(hits.shape, bool)
                for k in np.flatnonzero(full.any(axis=0)):
                    rows = np.flatnonzero(full[:, k])
                    exact[rows, k] = np.asarray(pc.match_substring(norm.take(pa.array(rows)), texts[k]))
                raw = hits / np.sqrt(np.maximum(1, sizes * np.minimum(n[:, None], 4 * sizes)))
                i, k = np.nonzero(exact | ((hits > 0) & (raw >= least - 1e-6)))
                sets = {x: set(found[x].as_py()) for x in np.unique(i).tolist()}
                matched = [[t for t in names[b] if t in sets[a]] for a, b in zip(i.tolist(), k.tolist())]
                columns = [part.column(c).take(pa.array(i)) for c in told] + [queries_.take(pa.array(k))]
                columns += [pa.array(c) for c in (sizes[k], n[i], hits[i, k].astype(np.int64), exact[i, k])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(matched, pa.list_(pa.string()))], names=shape.names)

    if not block:
        met = entries.limit(0).mapInArrow(lambda batches: iter(()), shape)
    else:
        met = entries.select(*told, "norm", "terms").mapInArrow(run, shape)
    out = met.withColumn("score", rated(F.col("hits"), F.col("nq"), F.col("nd"), F.col("exact"))).filter(F.col("score") >= least)
    return out.select("query_id", "owner", "entry", "type", "linked", "heading", "score", "exact", "matched", *[c for c in ("_version",) if c in told])


def rated(hits: Column, nq: Column, nd: Column, exact: Column) -> Column:
    """The score of a query of nq terms and a passage of nd."""
    raw = F.when((nq == 0) | (nd == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.when(exact, 0.9).otherwise(0.0), hits / F.sqrt(nq * F.least(nd, nq * 4)))))
    return F.round(raw, 6)


def scored(both: DataFrame, least: float) -> DataFrame:
    """The hits among pairs of entries(terms as found) and wanted queries."""
    matched = F.array_intersect("terms", "found")
    hits = F.size("matched") + F.size(F.filter("matched", lambda t: F.startswith(t, F.lit("synonym_"))))
    exact = (F.length("q") >= 2) & F.contains("norm", F.col("q"))
    told = both.withColumn("matched", matched).withColumn("exact", exact)
    out = told.withColumn("score", rated(hits, F.size("terms"), F.size("found"), F.col("exact"))).filter(F.col("score") >= least)
    return out.select("query_id", "owner", "entry", "type", "linked", "heading", "score", "exact", "matched")


def within_documents(hits: DataFrame, most: int = 5) -> DataFrame:
    """The best passages of each document for each query, those that come first in it where scores are equal."""
    return R.top(hits, ["query_id", "owner"], [F.col("score").desc(), "entry"], most)


def across_documents(hits: DataFrame, each: int = 2, most: int = 5) -> DataFrame:
    """The best passages of all documents, `each` of a document at most."""
    return R.group_capped(hits, "owner", each, most, [F.col("score").desc(), "owner", "entry"])


def fused(lexical: DataFrame, dense: DataFrame, least: float = R.DENSE_LEAST, most: int = 5, caps: tuple[int, int] = (1, 2)) -> DataFrame:
    """(query_id, owner, entry, score, lexical_score, dense_score, rank): both branches by reciprocal ranks, capped for each card and document.

    lexical are hits of overlaps(); dense(query_id, owner, entry, type, score) are cosines. Ties
    of the fused score go to the higher lexical one, then by owner and entry.
    """
    keys = ["query_id", "owner", "entry", "type"]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "owner", "entry")
    scale = (R.RRF_K + 1) / (R.LEXICAL_WEIGHT + R.DENSE_WEIGHT)
    branch = lambda d, w: d.withColumn("part", w * scale / (R.RRF_K + F.row_number().over(order)))
    word = branch(lexical, R.LEXICAL_WEIGHT).select(*keys, "part", F.col("score").alias("ls"), F.lit(0.0).alias("ds"))
    near = branch(dense.filter(F.col("score") >= least), R.DENSE_WEIGHT).select(*keys, "part", F.lit(0.0).alias("ls"), F.col("score").alias("ds"))
    both = word.unionByName(near).groupBy(*keys).agg(F.round(F.sum("part"), 6).alias("score"), F.max("ls").alias("lexical_score"), F.max("ds").alias("dense_score"))
    best = [F.col("score").desc(), F.col("lexical_score").desc(), F.col("owner"), F.col("entry")]
    place = F.row_number().over(Window.partitionBy("query_id", "type", "owner").orderBy(*best))
    capped = both.withColumn("_n", place).filter(F.col("_n") <= F.when(F.col("type") == "card", caps[0]).otherwise(caps[1])).drop("_n")
    return R.top(capped, ["query_id"], best, most).drop("type")
