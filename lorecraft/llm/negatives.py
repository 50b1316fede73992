"""Hard-negative mining by threshold joins with an inverted index (L2AP style).

Anchors are a stated set of rows that is searched against all rows, in blocks of both: a task
gets one block of anchors and one of rows. There the dimensions are ordered by how much they
hold of all squared length, and an inverted index of the rows is built in that order: a row
enters the lists of its first dimensions and leaves out all those from which the norm of its
rest, times that of any anchor's rest, stays below the threshold. Partial scores grow list by
list, pairs are dropped when their partial score and the remaining norms can't reach the
threshold, and only pairs that are left read the omitted dimensions for their exact score.

A threshold join is made again with a lower threshold for those windows that are not full yet,
so that most anchors never see a low threshold. Each task returns the best few of a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores between these percents of the positive's score.
LOW, HIGH = 80, 100
#: Thresholds for positives as shares of the anchor's product with itself; after the last one, all rows.
POSITIVE_STEPS = (0.6, 0.3)
#: Thresholds for negatives in percent of the positive's score; the last one is LOW.
NEGATIVE_STEPS = (93,)
ROW_BLOCK, ANCHOR_BLOCK = 8192, 4096
#: Pairs that a task scores at once.
TILE_PAIRS = 1 << 20
#: Dimensions whose lists are read between two tests of the remaining norms.
LIST_DIMS = 8
#: Components stay within this, so that a product of long vectors fits 64 bits.
MOST = 1 << 28


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers: floor(scale * x), x as a double, cut off at MOST."""
    whole = lambda x: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), F.lit(float(scale)) * x.cast("double")))).cast("int")
    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix; short ones end in zeros."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def rest_norms(m: np.ndarray, starts: list[int]) -> np.ndarray:
    """Norms of the rows from each of these dimensions on, then a column of zeros; rounded up a little."""
    own = np.stack([np.sqrt((m[:, at:] ** 2).sum(axis=1)) for at in starts] + [np.zeros(len(m))], axis=1)
    return own * (1 + 1e-9)


def threshold_pairs(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of all pairs whose product reaches the anchor's threshold.

    Products are exact: in doubles while they are below 2^53, else in 64-bit integers.
    """
    dims = rows.shape[1]
    none = np.zeros(0, np.int64)
    if not len(rows) or not len(anchors) or not dims:
        i, j = np.nonzero(np.zeros((len(rows), len(anchors))) >= least)
        return i, j, np.zeros(len(i), np.int64)
    largest = max(1.0, np.abs(rows).max()) * max(1.0, np.abs(anchors).max()) * dims
    kind = np.float64 if largest < 2**53 else np.int64
    order = np.argsort(-((rows**2).sum(axis=0) + (anchors**2).sum(axis=0)), kind="stable")
    rows, anchors = rows[:, order], anchors[:, order]
    starts = list(range(0, dims, LIST_DIMS))
    row_rest, anchor_rest = rest_norms(rows, starts), rest_norms(anchors, starts)
    # a row leaves out the lists from the first one on where its rest can't reach any anchor's threshold
    with np.errstate(divide="ignore", invalid="ignore"):
        limit = np.where(least[:, None] > 0, least[:, None] / anchor_rest[:, :-1], 0.0).min(axis=0)
    depth = (row_rest[:, :-1] >= limit).cumprod(axis=1).sum(axis=1).astype(np.int64)
    by_depth = np.argsort(-depth, kind="stable")
    by_depth = by_depth[: int((depth > 0).sum())]
    if not len(by_depth):
        return none, none, none
    depth, own, own_rest = depth[by_depth], rows[by_depth].astype(kind), row_rest[by_depth]
    asked = anchors.astype(kind)
    lists = int(depth[0])
    ends = np.searchsorted(-depth, -np.arange(lists), "left")  # list c holds the first ends[c] rows
    score = np.zeros((len(own), len(asked)), kind)
    i = j = part = None
    for c in range(lists):
        at = slice(starts[c], starts[c] + LIST_DIMS)
        if i is None:
            score[: ends[c]] += own[: ends[c], at] @ asked[:, at].T
            if c + 1 == lists or c % 2:
                # what a pair may still gain: both rests after this list, or after the row's own last list
                at = np.minimum(depth, c + 1)
                open_ = score + own_rest[np.arange(len(own)), at][:, None] * anchor_rest.T[at] >= least
                if c + 1 == lists or open_.mean() < 0.05:
                    i, j = np.nonzero(open_)
                    part = score[i, j]
        else:
            listed = depth[i] > c
            part[listed] += np.einsum("nd,nd->n", own[i[listed], at], asked[j[listed], at])
            alive = part + own_rest[i, np.minimum(depth[i], c + 1)] * anchor_rest[j, np.minimum(depth[i], c + 1)] >= least[j]
            i, j, part = i[alive], j[alive], part[alive]
    # the omitted dimensions of those that are left
    for c in range(len(starts)):
        left = depth[i] <= c
        if left.any():
            at = slice(starts[c], starts[c] + LIST_DIMS)
            part[left] += np.einsum("nd,nd->n", own[i[left], at], asked[j[left], at])
    reached = part >= least[j]
    return by_depth[i[reached]], j[reached], part[reached].astype(np.int64)


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    own = group[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[rank < k]


def searched(rows: DataFrame, windows: DataFrame, same_label: bool, k: int) -> DataFrame:
    """(anchor, place, id, score): for each window the first k rows of the same label, or of others.

    rows(row, id, label, v) and windows(anchor, id, label, v, ranges array of (place, least,
    most)). A row counts for a range if its score is within it. Rows with the anchor's id are
    left out.
    """
    n_rows, n_windows = rows.count(), windows.count()
    rbs, wbs = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_windows // ANCHOR_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "label", "v", block("row", rbs).alias("rb")).withColumn("wb", every(wbs))
    # names of their own, as both sides may come from one table
    right = windows.select("anchor", "ranges", *[F.col(c).alias(f"own_{c}") for c in ("id", "label", "v")], block("anchor", wbs).alias("wb")).withColumn("rb", every(rbs))
    schema = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def run(r: pa.Table, w: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if r.num_rows and w.num_rows:
            vectors = r.column("v"), w.column("own_v")
            dims = max(pc.max(pc.list_value_length(c)).as_py() for c in vectors)
            x, q = (matrix(c, dims) for c in vectors)
            ids, labels = (r.column(c).to_numpy() for c in ("id", "label"))
            anchor, own_ids, own_labels = (w.column(c).to_numpy() for c in ("anchor", "own_id", "own_label"))
            ranges = w.column("ranges").to_pylist()
            n_ranges = np.array([len(g) for g in ranges])
            first = np.cumsum(n_ranges) - n_ranges
            place, low, high = (np.array([g[c] for own in ranges for g in own], np.int64) for c in ("place", "least", "most"))
            least = np.array([min(g["least"] for g in own) for own in ranges], np.float64)
            # positives only meet rows of their label; negatives meet all
            groups = [(np.flatnonzero(labels == v), np.flatnonzero(own_labels == v)) for v in np.unique(own_labels)] if same_label else [(np.arange(len(x)), np.arange(len(q)))]
            for xs, qs in groups:
                step = max(1, TILE_PAIRS // max(1, len(xs)))
                for at in range(0, len(qs), step):
                    own = qs[at : at + step]
                    i, j, score = threshold_pairs(x[xs], q[own], least[own])
                    i, j = xs[i], own[j]
                    fits = (ids[i] != own_ids[j]) & ((labels[i] == own_labels[j]) == same_label)
                    i, j, score = i[fits], j[fits], score[fits]
                    # a pair for each range of its anchor, then those that it is in
                    times = n_ranges[j]
                    pair = np.repeat(np.arange(len(i)), times)
                    g = np.repeat(first[j], times) + np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
                    inside = (score[pair] >= low[g]) & (score[pair] <= high[g])
                    pair, g = pair[inside], g[inside]
                    best = best_of(g, score[pair], ids[i[pair]], k)
                    pair, g = pair[best], g[best]
                    parts.append((anchor[j[pair]], place[g], ids[i[pair]], score[pair]))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    told = left.groupBy("wb", "rb").cogroup(right.groupBy("wb", "rb")).applyInArrow(run, "anchor long, place int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id"))
    return told.withColumn("rank", rank).filter(F.col("rank") <= k)


def until_full(rows: DataFrame, windows: DataFrame, steps: list[Column], same_label: bool, k: int) -> list[DataFrame]:
    """Tables of (anchor, place, id, score, rank) of windows(anchor, id, label, v, place, least, most), one for each step that was needed.

    steps are thresholds, falling to what the window allows; a window that has k rows at one is
    closed, as no other row can come before them.
    """
    own = Window.partitionBy("anchor")
    found: list[DataFrame] = []
    left = windows
    for n, step in enumerate(steps):
        last = n == len(steps) - 1
        range_ = F.struct(F.col("place").cast("int").alias("place"), F.greatest(F.col("least"), step).cast("long").alias("least"), F.col("most").cast("long").alias("most"))
        asked = left.withColumn("ranges", F.collect_list(range_).over(own)).withColumn("_n", F.row_number().over(own.orderBy("place"))).filter("_n = 1")
        hits = stored(searched(rows, asked, same_label, k), "hits")
        if last:
            found.append(hits)
            break
        full = hits.filter(F.col("rank") == k).select("anchor", "place")
        found.append(hits.join(full, ["anchor", "place"], "left_semi"))
        before, left = left, stored(left.join(full, ["anchor", "place"], "left_anti"), "windows")
        if n:
            drop_stored(before)
        if left.isEmpty():
            break
    return found


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), long but rank int.

    A row's score is the integer product of its components, floor(scale * x), with the anchor's.
    Higher scores come first, ties by smaller id. Positives of an anchor are its first rows of
    its own label; for each, the first rows of other labels follow that satisfy low * positive
    <= 100 * negative <= high * positive.

    Rows with a null id, label or vector or any null or non-finite component take no part.
    Vectors may have any length: a shorter one ends in zeros, an empty one scores 0. Components
    beyond 2^28 after scaling are cut off there. Rows that repeat an id are rows of their own,
    as candidates and as anchors, but never partners of each other. Anchors with fewer rows of
    their label have fewer positives, one without any gives no rows. is_anchor sees all columns
    of vectors; other columns are not read. An empty table gives an empty table.
    """
    told = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    shaped = told.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = stored(shaped.withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.filter("asks").select(F.col("row").alias("anchor"), "id", "label", "v")
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    all_ = F.lit(-(2**62))
    # the product with itself is at least the number of components that are not zero
    windows = anchors.withColumn("place", F.lit(0)).withColumn("least", all_).withColumn("most", F.lit(2**62)).withColumn("own", own)
    steps = [F.ceil(F.col("own") * share).cast("long") for share in POSITIVE_STEPS] + [all_]
    liked = stored(union(until_full(rows, windows, steps, True, positives)).select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "liked")
    percent = lambda p: F.ceil(F.col("positive_score") * p / F.lit(100)).cast("long")
    bounds = liked.withColumn("least", percent(low)).withColumn("most", F.floor(F.col("positive_score") * high / F.lit(100)).cast("long"))
    windows = bounds.filter("least <= most").select("anchor", "place", "least", "most", "positive_score").join(anchors, "anchor")
    steps = [percent(p) for p in NEGATIVE_STEPS if p > low] + [all_]
    hard = union(until_full(rows, windows, steps, False, negatives))
    out = hard.join(liked, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def op12_query(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", label.alias("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0)


OP12_SQL = f"""
WITH told AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM told a JOIN told b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
), ranked AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= {NEGATIVES}
"""
