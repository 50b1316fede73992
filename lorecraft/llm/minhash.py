"""MinHash near-dedup with bottom-k sketches of one hash function.

A document is the set of its 5-word shingles; its sketch keeps the k smallest hashes. Rows
with equal sets form a class, and the work is done on classes. Inverted lists of retained
values generate candidates: only values that two classes retain, and of each class only so
many of its rarest ones that a pair over the threshold must meet in one. The shingles that a
candidate shares with no other one bound its similarity to any of them, which drops most
false candidates. A list meets at its most common text, so a group of n near copies gives n
pairs; what the links found so far do not join is paired again until no list holds an
untried pair between components. The sketch of the union estimates each pair, and the full
sets of the texts decide.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, join_heavy, settings, stored
from .graph import components

K = 40
SHINGLE = 5
#: Standard deviations of a sketch's share of common values that a pair at the threshold may
#: fall short by: fewer than one such pair in a million is lost to candidates or estimates.
DEVIATIONS = 5.3
#: Texts of a block that pairs are verified against, and texts that one copy of it meets.
BLOCK_TEXTS, PART_ROWS = 16, 512
REMEMBERED = 400_000
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"
#: Rounds join many small tables; each broadcast of one would take memory and a thread of the driver for a while.
NO_BROADCASTS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
#: Pairs compared for one link from which another round of centres costs more than it joins; the last round is exact in any case.
FEW_LINKS = 50
#: Times that candidates are held against each other's shingles; each time fewer are left.
PRUNINGS = 2
#: Columns of 64 bits of a class's parities.
PARITIES = [f"p{i}" for i in range(8)]


def least_share(threshold: int, k: int) -> float:
    """The share of k sketch values that two sets of a similarity of threshold percent have in common at least.

    The number is binomial, so its deviation follows from the threshold and k. A threshold so
    low that not one value would be asked for is refused: it needs a larger k.
    """
    t = threshold / 100
    share = t - DEVIATIONS * math.sqrt(t * (1 - t) / k)
    if share * k < 1:
        raise ValueError(f"{k} sketch values are too few for a threshold of {threshold} percent")
    return share


class WordHash(dict):
    """64-bit hashes of words, worked out once for each word."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


# Odd multipliers for the words of a shingle, by their place.
_PLACES = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) | 1 for k in range(64)], np.uint64)


def shingle_stream(text: str | None, known: WordHash, size: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle of the text, in order: A-Z in lower case, words [^\\x20\\x09-\\x0D]+.

    Fewer words than size make one shingle; no words make none.
    """
    # bytes.split and bytes.lower know exactly these white space characters and A-Z
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    if len(known) > REMEMBERED:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _PLACES[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of shingles has it.

    Of two sets, no more bits differ than there are shingles that only one of them has.
    """
    bits = 64 * len(PARITIES)
    return np.packbits(np.bincount(shingles & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, size: int) -> DataFrame:
    """(id, n_shingles, set_id, sketch, p0...): set_id is equal for equal sets; null for empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = np.unique(shingle_stream(text, known, size))
                rows.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None, s[:k], parities(s)))
            bits = np.frombuffer(b"".join(r[3] for r in rows), "<i8").reshape(-1, len(PARITIES))
            yield pd.DataFrame({"id": pdf["id"], "n_shingles": [r[0] for r in rows], "set_id": [r[1] for r in rows], "sketch": [r[2] for r in rows]} | {c: bits[:, i] for i, c in enumerate(PARITIES)})

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, set_id string, sketch array<long>, {', '.join(f'{c} long' for c in PARITIES)}")


def retained_lists(classes: DataFrame, share: float) -> DataFrame:
    """(v, cls, n_shingles): inverted lists of the rarest retained values of classes(cls, n_shingles, sketch)."""
    entries = classes.select("cls", "n_shingles", F.size("sketch").alias("width"), F.explode("sketch").alias("v"))
    counts = entries.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1")
    # a value that many classes retain is one row of counts: adaptive execution cuts its side of the join
    shared = entries.join(counts, "v")
    ranked = shared.groupBy("cls", "n_shingles", "width").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("values"))
    # values that no other class retains are rarer still and come before the shared ones
    room = F.col("width") - F.ceil(F.col("width") * share) + 1 - (F.col("width") - F.size("values"))
    return ranked.filter(room > 0).select("cls", "n_shingles", F.explode(F.slice("values", F.lit(1), room.cast("int"))["v"]).alias("v"))


def candidate_lists(lists: DataFrame, texts: DataFrame, threshold: int, size: int) -> DataFrame:
    """lists with `common`: how many of a class's shingles any other class of lists has; texts(cls, text) are theirs.

    A pair's intersection is no larger than the smaller `common`, so a class whose own
    shingles alone keep it under the threshold goes. This is exact: all shingles are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            sets = [np.unique(shingle_stream(t, known, size)) for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], ["cls", "v"])

    kind = texts.schema["cls"].dataType.simpleString()
    shingles = texts.mapInArrow(run, f"cls {kind}, v long")
    alone = shingles.groupBy("v").agg(F.count("*").alias("n"), F.min("cls").alias("cls")).filter("n = 1").groupBy("cls").agg(F.count("*").alias("alone"))
    told = lists.join(alone, "cls", "left").withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0))).drop("alone")
    return told.filter(100 * F.col("common") >= threshold * F.col("n_shingles"))


def open_lists(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """lists(v, cls, n_shingles, common) with `label`, and `most`, the list's most frequent label; only lists of two labels or more.

    A list whose classes are all of one component has nothing to find any more, now or later.
    """
    if labels is not None:
        # a class has a bounded number of list entries, so labels meet entries without skew
        lists = lists.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    else:
        lists = lists.withColumn("label", F.col("cls"))
    by_label = lists.groupBy("v", "label").agg(F.count("*").alias("n"))
    most = by_label.groupBy("v").agg(F.max(F.struct("n", "label"))["label"].alias("most"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    return lists.join(most, "v")


def possible(threshold: int) -> Column:
    """Whether `common` of two classes allows a link between components: of n_shingles and label with nx, cx and lx."""
    most = F.least("common", "cx")
    return (F.col("label") != F.col("lx")) & (100 * most >= threshold * (F.col("n_shingles") + F.col("nx") - most))


def others(told: DataFrame, all_of: bool = False, *more: Column) -> DataFrame:
    """The classes outside their list's most frequent component, or all of them, as x, with more columns."""
    return told.filter(F.lit(all_of) | (F.col("label") != F.col("most"))).select("v", F.col("cls").alias("x"), F.col("n_shingles").alias("nx"), F.col("common").alias("cx"), F.col("label").alias("lx"), *more)


def star_pairs(told: DataFrame, threshold: int, first: bool) -> DataFrame:
    """(v, x, m): in each open list one class x with all others of other components.

    x lies outside the most frequent component, but in the first round, and has the fewest
    shingles of its own: what links with anything is likely to link with it.
    """
    central = F.struct(((F.col("nx") - F.col("cx")) / F.col("nx")).alias("own"), F.col("x").alias("x"))
    centre = others(told, first).groupBy("v").agg(F.min_by(F.struct("x", "nx", "cx", "lx"), central).alias("s")).select("v", "s.*")
    return told.join(centre, "v").filter(possible(threshold)).select("v", "x", F.col("cls").alias("m"))


def rest_pairs(told: DataFrame, centres: DataFrame, tested: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    """(x, m): every class outside its list's most frequent component with all of other components.

    centres(v, x) were compared with their lists, and tested(x, m, jaccard) tells the results.
    Jaccard distances keep the triangle inequality, so a pair goes whose distances from one
    centre of the list differ by more than a link allows: it can't be one. Nor can a pair whose
    parities, bits(cls, n_shingles, p0...), differ in more places than a link has shingles of one
    side only, which tells near copies just under the threshold apart inside the join, where
    pairs of all others would come once for each list that both are in.
    """
    to = centres.groupBy("v").agg(F.min("x").alias("centre"))
    known = tested.select(F.col("x").alias("centre"), F.col("m").alias("cls"), "jaccard").unionByName(tested.select(F.col("m").alias("centre"), F.col("x").alias("cls"), "jaccard")).distinct()
    told = told.join(to, "v", "left").join(known, ["centre", "cls"], "left").join(bits, ["cls", "n_shingles"])
    far = F.when(F.col("cls") == F.col("centre"), 0.0).otherwise(1 - F.col("jaccard"))
    # narrow rows, written once: both sides of the join on lists read them
    told = stored(told.select("v", "cls", "n_shingles", "common", "label", "most", far.alias("far"), *PARITIES), "told")
    near = F.coalesce(F.abs(F.col("far") - F.col("far_x")) <= 1 - threshold / 100 + 1e-9, F.lit(True))
    differ = functools.reduce(operator.add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_x"))) for c in PARITIES])
    alike = differ * (100 + threshold) <= (F.col("n_shingles") + F.col("nx")) * (100 - threshold)
    x = others(told, False, F.col("far").alias("far_x"), *[F.col(c).alias(f"{c}_x") for c in PARITIES])
    return told.join(x, "v").filter(possible(threshold) & near & alike).select("x", F.col("cls").alias("m"))


def unordered(pairs: DataFrame) -> DataFrame:
    """(a, b, x, m): each pair once, whichever of the two was x."""
    return pairs.select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b"), "x", "m").dropDuplicates(["a", "b"])


def estimated(pairs: DataFrame, classes: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs whose union sketch, the k smallest of both sketches, has a share of common values of least or more."""
    s = classes.select("cls", "sketch")
    both = pairs.join(s.select(F.col("cls").alias("x"), F.col("sketch").alias("sx")), "x").join(s.select(F.col("cls").alias("m"), F.col("sketch").alias("sm")), "m")
    union = F.slice(F.sort_array(F.array_union("sx", "sm")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sx", "sm"), union))
    return both.filter(common >= F.lit(least) * F.size(union)).select("x", "m")


def compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(x, m, jaccard) of stored pairs, by their full shingle sets; texts(cls, text).

    The texts of x are dealt into small blocks. A row for each m and block brings the text of m
    once, however many x of the block it meets. A block that meets many m is copied for every
    PART_ROWS of them, so no task gets more.
    """
    blocks = max(1, pairs.select("x").distinct().count() // BLOCK_TEXTS)
    block = F.pmod(F.xxhash64("x"), F.lit(blocks)).alias("block")
    met = pairs.groupBy("m", block).agg(F.collect_set("x").alias("xs"))
    parts = met.groupBy("block").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    rows = met.join(parts, "block").select("m", "xs", "block", F.pmod(F.xxhash64("m"), "parts").alias("part")).join(texts.select(F.col("cls").alias("m"), F.col("text").alias("tm")), "m")
    held = pairs.select("x").distinct().join(texts.select(F.col("cls").alias("x"), F.col("text").alias("tx")), "x").select("x", "tx", block)
    held = held.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "x", "tx")
    kind = pairs.schema["x"].dataType

    def run(key: tuple, rows: pa.Table, held: pa.Table) -> pa.Table:
        known = WordHash()
        sets: dict = {}
        for x, tx in zip(held["x"].to_pylist(), held["tx"].to_pylist()):
            sets.setdefault(x, []).append(np.unique(shingle_stream(tx, known, size)))
        out: list[tuple] = []
        for m, tm, xs in zip(rows["m"].to_pylist(), rows["tm"].to_pylist(), rows["xs"].to_pylist()):
            other = np.unique(shingle_stream(tm, known, size))
            for x in xs:
                for own in sets.get(x, []):  # ids that repeat have a set for each of their texts
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    out.append((x, m, common / (len(own) + len(other) - common), common, len(own) + len(other) - common))
        columns = list(zip(*out)) if out else [()] * 5
        types = [rows["m"].type, rows["m"].type, pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["x", "m", "jaccard", "common", "total"])

    shape = f"x {kind.simpleString()}, m {kind.simpleString()}, jaccard double, common long, total long"
    return rows.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(run, shape)


def memberships(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, threshold: int, k: int, size: int) -> DataFrame:
    """(set_id, n, label) of each set of shingles in rows, the sketches of docs: how many rows have it, and the smallest id that links reach."""
    spark, share = docs.sparkSession, least_share(threshold, k)
    classes = stored(
        rows.filter("set_id IS NOT NULL AND id IS NOT NULL").groupBy("set_id").agg(
            F.min("id").alias("cls"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n_shingles", "sketch", *PARITIES)]
        ),
        "classes",
    )
    # classes that share their smallest id, where ids repeat, are linked by that id already
    lists = stored(retained_lists(classes.select("cls", "n_shingles", "sketch"), share), "lists")
    texts = None
    for _ in range(PRUNINGS):
        source = docs.select(F.col(id_col).alias("cls"), F.col(text_col).cast("string").alias("text")) if texts is None else texts
        old = texts, lists
        texts = stored(source.join(lists.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls", "text"]), "texts")
        lists = stored(candidate_lists(lists.drop("common"), texts, threshold, size), "candidates")
        drop_stored(*old)

    def links_of(pairs: DataFrame) -> DataFrame:
        """tested(x, m, jaccard, ...) of the pairs that the sketches let through."""
        some = stored(estimated(pairs, classes, k, share), "estimated")
        # few bytes may be much work here: partitions are not joined by their size
        with settings(spark, {COALESCE: "false"}):
            out = stored(compared(some, texts, size), "compared")
        drop_stored(some)
        return out

    linked = F.lit(100) * F.col("common") >= F.lit(threshold) * F.col("total")
    labels, tested, tried, centres, first = None, None, None, None, True
    while True:
        # classes with other ids join the lists that are still open only
        old, lists = lists, stored(open_lists(lists.drop("label", "most"), labels), "open")
        drop_stored(old)
        star = stored(star_pairs(lists, threshold, first), "star")
        pairs = unordered(star.select("x", "m"))
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        found = links_of(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        tested = found if tested is None else tested.unionByName(found)
        centres = star.select("v", "x").distinct() if centres is None else centres
        first = False
        if found.filter(linked).count() * FEW_LINKS <= pairs.count():
            break
        drop_stored(labels)
        labels = components(tested.filter(linked).select(F.col("x").alias("a"), F.col("m").alias("b")))
    # what the centres leave apart is compared in full, but for pairs that can't be links
    pairs = stored(unordered(rest_pairs(lists, centres, tested, classes.select("cls", "n_shingles", *PARITIES).distinct(), threshold)).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    tested = tested.unionByName(links_of(pairs))
    if tested.filter(linked).limit(1).count():
        labels = components(tested.filter(linked).select(F.col("x").alias("a"), F.col("m").alias("b")))
    table = classes.select("set_id", "n", "cls")
    if labels is not None:
        table = table.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    else:
        table = table.withColumn("label", F.col("cls"))
    return stored(table.select("set_id", "n", F.coalesce("label", "cls").alias("label")), "membership")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85, k: int = K, size: int = SHINGLE) -> DataFrame:
    """A row for each row of docs: id_col, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their shingle sets is threshold / 100
    or more, and component_id is the smallest id that links reach, so one document of each
    component is kept. A null or empty text, or one of white space, has no shingle, is linked
    with nothing and kept. A row with a null id is linked with nothing, gets a null
    component_id and is kept. Rows that share an id are one document with the links of all.
    Other columns are not read. An empty table gives an empty table.
    """
    least_share(threshold, k)
    rows = stored(sketches(docs, id_col, text_col, k, size), "sketches")
    with settings(docs.sparkSession, NO_BROADCASTS):
        table = memberships(docs, rows, id_col, text_col, threshold, k, size)
    told = join_heavy(rows.select("id", "n_shingles", "set_id"), table, "set_id", "n", rows.count())
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    return told.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), threshold=85)


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), e AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents WHERE doc_id IN (SELECT a FROM e)
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (
  WITH RECURSIVE t(doc_id, r) AS (SELECT doc_id, r FROM reach UNION SELECT e.b, t.r FROM t JOIN e ON e.a = t.doc_id) SELECT doc_id, min(r) AS component_id FROM t GROUP BY doc_id
) c ON c.doc_id = d.doc_id
"""
