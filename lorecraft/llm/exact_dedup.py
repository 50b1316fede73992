"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A batch is first grouped by itself: one entry for each digest of the normalised text. Each
earlier batch is an immutable snapshot of such entries with one binary-fuse filter for every
shard of its digest space. New entries are screened by the filters; only those that may be
known are joined with the snapshot's exact entries. Groups of two or more are then checked
byte by byte, and texts that share a digest and differ are told apart by the text itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_KEYS, SPACE, heavy_rows, join_heavy, stored

#: Entries of a shard, which one task holds: the filter of a shard is about 1.15 bytes for each.
SHARD_ENTRIES = 100_000


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


# ---- binary-fuse filter, three places for each key, 8-bit fingerprints


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def fuse_filter(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(seed, segment length, fingerprints) of distinct uint64 keys, built by peeling in rounds."""
    n = len(keys)
    segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    segment = min(segment, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    starts = max(1, math.ceil(max(n, 2) * factor / segment) - 2) * segment
    size = starts + 2 * segment
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        places = np.stack(_places(h, segment, starts))
        count = np.bincount(places.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in places:
            np.bitwise_xor.at(held, row, np.arange(n))
        order, single = [], np.flatnonzero(count == 1)
        while len(single):
            found, at = np.unique(held[single], return_index=True)
            order.append((found, single[at]))
            touched = places[:, found].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(found, 3))
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if sum(len(x) for x, _ in order) == n:
            table, marks = np.zeros(size, np.uint8), _fingerprint(h)
            for found, slot in reversed(order):
                table[slot] = 0
                rest = table[places[0, found]] ^ table[places[1, found]] ^ table[places[2, found]]
                table[slot] = marks[found] ^ rest
            return seed, segment, table.tobytes()
    raise RuntimeError("a binary-fuse filter could not be built")


def fuse_contains(seed: int, segment: int, table: bytes, keys: np.ndarray) -> np.ndarray:
    """False only for keys that the filter was not built from."""
    marks = np.frombuffer(table, np.uint8)
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
    a, b, c = _places(h, segment, len(marks) - 2 * segment)
    return (marks[a] ^ marks[b] ^ marks[c]) == _fingerprint(h)


# ---- snapshots


@dataclass
class Snapshot:
    """entries(digest, lead, n), filters(shard, seed, segment, marks) and the number of shards."""

    entries: DataFrame
    filters: DataFrame
    shards: int


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in digests], np.uint64)


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def entries_of(rows: DataFrame) -> DataFrame:
    """One entry for each digest of rows(id, chars, digest): the leading row and the number of rows."""
    return rows.groupBy("digest").agg(F.min(lead(F.col("chars"), F.col("id"))).alias("lead"), F.count("*").alias("n"))


def lead(chars: Column, id_: Column) -> Column:
    """Sorts first for the row that stays: most characters, then smallest id; null ids come last."""
    return F.struct((-chars).alias("less"), id_.isNull().alias("unknown"), id_.alias("id"))


def make_snapshot(entries: DataFrame, n_shards: int) -> Snapshot:
    """entries must be stored, as they are read again; n_shards fixes how many one filter holds."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, marks = fuse_filter(np.unique(_keys(pdf["digest"])))
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "seed": seed, "segment": segment, "marks": [marks]})

    sharded = entries.select("digest", shard_of(F.col("digest"), n_shards).alias("shard"))
    filters = sharded.groupBy("shard").applyInPandas(build, "shard int, seed long, segment long, marks binary")
    return Snapshot(entries, stored(filters, "filters"), n_shards)


def screen(entries: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(digest, maybe): whether the snapshot's filters let each digest pass."""

    def probe(new: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(new):
            return pd.DataFrame({"digest": new["digest"], "maybe": False})
        f = own.iloc[0]
        return pd.DataFrame({"digest": new["digest"], "maybe": fuse_contains(int(f["seed"]), int(f["segment"]), f["marks"], _keys(new["digest"]))})

    new = entries.select("digest", shard_of(F.col("digest"), snapshot.shards).alias("shard"))
    return new.groupBy("shard").cogroup(snapshot.filters.groupBy("shard")).applyInPandas(probe, "digest string, maybe boolean")


def grouped(batches: list[DataFrame]) -> DataFrame:
    """Entries of all batches of stored rows(id, chars, digest), each screened by the snapshots before it."""
    groups, snapshots = None, []
    for k, rows in enumerate(batches):
        entries = stored(entries_of(rows), "entries")
        n = entries.count()
        if groups is None:
            groups = entries
        else:
            known = None
            for s in snapshots:
                # a shard of either side stays within SHARD_ENTRIES
                told = screen(entries, s).filter("maybe").select("digest")
                known = told if known is None else known.union(told)
            flagged = entries.join(known.distinct().withColumn("maybe", F.lit(True)), "digest", "left")
            flagged = stored(flagged, "screened")
            exact = groups.unionByName(flagged.filter("maybe").drop("maybe")).groupBy("digest").agg(F.min("lead").alias("lead"), F.sum("n").alias("n"))
            groups = exact.unionByName(flagged.filter("maybe IS NULL").drop("maybe"))
        if k + 1 < len(batches):
            snapshots.append(make_snapshot(entries, max(1, math.ceil(max(n, sum(b.count() for b in batches[k + 1 :])) / SHARD_ENTRIES))))
    return stored(groups, "groups")


def clashes(docs: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Digests under which docs(digest, norm) hold texts that differ in a byte."""
    several = groups.filter("n > 1").select("digest", "n")
    heavy = F.broadcast(heavy_rows(several, "n", total).select("digest"))
    light = several.filter(F.col("n") * HEAVY_KEYS < total).select("digest")
    differ = F.min("norm") < F.max("norm")
    # a heavy digest meets its own rows in each task, so that one row for a task is shuffled
    return docs.join(heavy, "digest", "left_semi").unionByName(docs.join(light, "digest", "left_semi")).groupBy("digest").agg(differ.alias("differ")).filter("differ").select("digest")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    docs come in so many batches, told by a hash of the id; each batch is screened against
    the snapshots of those before it. Texts are equal when they are identical without
    [\\x20\\x09-\\x0D]; a null text is an empty one, and empty texts are equal. Of equal texts the
    row with the most code points stays, then the smallest id; a null id stays only where all
    are null. Rows that repeat an id and stay both stay. Other columns are not read. An empty
    table gives an empty table. digest may be weaker (more clashes), never wrong.
    """
    batch = F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).cast("int")
    norm = normalised(F.col(text_col))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"), digest(norm).alias("digest"), batch.alias("batch")), "digests")
    total = rows.count()
    groups = grouped([rows.filter(F.col("batch") == b).drop("batch") for b in range(batches)])
    texts = docs.select(digest(norm).alias("digest"), norm.alias("norm"))
    clash = stored(clashes(texts, groups, total), "clashes")
    plain = rows
    if clashed := clash.count():
        plain = rows.join(clash, "digest", "left_anti")
    told = join_heavy(plain.drop("batch"), groups.filter("n > 1").select("digest", "n", F.col("lead.id").alias("lead_id"), F.lit(True).alias("found")), "digest", "n", total)
    keep = F.when(F.col("found"), F.col("lead_id")).otherwise(F.col("id"))
    shape = lambda keep, n: [F.col("id").alias(id_col), keep.alias("keep_id"), n.cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept")]
    out = told.select(*shape(keep, F.coalesce("n", F.lit(1))), F.col("digest").alias("text_sha256"))
    if clashed:
        own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"), norm.alias("norm"), digest(norm).alias("digest")).join(clash, "digest", "left_semi")
        by_text = own.groupBy("norm").agg(F.min(lead(F.col("chars"), F.col("id"))).alias("lead"), F.count("*").alias("n"))
        out = out.unionByName(own.join(by_text, "norm").select(*shape(F.col("lead.id"), F.col("n")), F.col("digest").alias("text_sha256")))
    return out


def op7_query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '') AS norm FROM documents
), g AS (
  SELECT norm, count(*)::BIGINT AS group_size, arg_min(doc_id, (-chars, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
