"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is a stream of words: its documents in a seeded order, cut into blocks of equal
length. The seats of a mix are such blocks. Seat j of a source has the quotient target / (2j - 1)
and seats go to the highest quotients, down to half a block, so a source gets its target in
blocks, rounded, and at most all its blocks as often as a document may be repeated. Bands of
quotients are the shards: the first k of them together are the apportionment of their own number
of seats, which gives each shard an integer quota of every source. Then a seeded order of the
blocks of a source tells which block fills which seat.

Sources, targets and quotas are rows of a table; only sums over all sources reach the driver.
Places in a stream are running sums over slices of its hash order, so a source that holds most
rows is many small groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

WEIGHTS = (5, 2, 1)
#: The mix in words, as a share of all words, and how often a document may be taken.
SHARE, COPIES = 1.5, 2
#: Words of a block.
BLOCK = 64
SHARDS, SEED = 24, 7
#: Rows that one slice of a stream's hash order holds, more or less.
SLICE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def ranked(table: DataFrame, *order: Column) -> DataFrame:
    """table with _rank, from 0 in this order: sorted by ranges, counted for each partition, never gathered."""
    at = stored(table.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each partition of the sort
    first = at.groupBy(part.alias("_part")).count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_first"))
    return at.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("_rank", F.col("_first") + place).drop("_at", "_part", "_first")


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(_row, id, source, size), stored: the number of words of each text, without the text."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    return stored(rows.withColumn("_row", F.monotonically_increasing_id()), "sized")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, copies: int = COPIES, block: int = BLOCK) -> DataFrame:
    """(sid, source, source_size, weight, target, n_blocks, quota), stored: a row for each source.

    Sources are numbered by code point, null last, and take the weights in turn. The mix holds
    share times all words, by weight; a target stops at copies times its source's words, and the
    excess goes to the other sources by weight until none is above. Each round is one sum over
    the sources; rounds end when no further source is full.
    """
    totals = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    sources = stored(totals.select(F.col("_rank").alias("sid"), "source", "source_size", weight.alias("weight")), "sources")
    drop_stored(totals)
    most, level, n_full = F.col("source_size") * float(copies), 0.0, -1
    while True:
        full = F.col("weight") * level > most
        sums = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if sums[0] is None or sums[3] == n_full:
            break
        n_full = sums[3]
        level = math.inf if sums[2] is None else (share * sums[0] - sums[1]) / sums[2]
    target = F.when(most == 0, F.lit(0.0)).otherwise(F.least(F.col("weight") * level, most))
    n_blocks = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.floor(F.col("source_size") / block + 0.5))).otherwise(0).cast("long")
    quota = F.least(F.floor(F.col("target") / block + 0.5), copies * F.col("n_blocks")).cast("long")
    out = stored(sources.withColumn("target", target).withColumn("n_blocks", n_blocks).withColumn("quota", quota), "targets")
    drop_stored(sources)
    return out


def shard_of(seat: Column, block: int, shards: int) -> Column:
    """The shard that holds a seat (from 1) of a source: the band of its quotient."""
    band = F.ceil((seat - 0.5) * F.lit(float(block * shards)) / F.col("target")) - 1
    return F.greatest(F.lit(0), F.least(F.lit(shards - 1), band)).cast("int")


def shard_quotas(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(shard, source, quota): how many blocks a shard takes of a source, from the result of targets()."""
    until = lambda k: F.when(k == shards, F.col("quota")).otherwise(F.least(F.col("quota"), F.floor(k * F.col("target") / F.lit(float(block * shards)) + 0.5)))
    rows = sources.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return rows.select("shard", "source", (until(F.col("shard") + 1) - until(F.col("shard"))).cast("long").alias("quota"))


def running(rows: DataFrame, hash_: Column, weight: Column, n_rows: int, *ties: str) -> DataFrame:
    """rows with _before: the sum of weight over the rows of the same sid that come first in the order of an md5.

    The order is cut into slices by the first digits of the hash, as many as the number of rows
    asks for; sums of slices, then sums inside each one, so no window holds a whole source.
    """
    digits = max(0, math.ceil(math.log(max(1, n_rows / SLICE_ROWS), 16)))
    own = rows.withColumn("_hash", hash_).withColumn("_weight", weight).withColumn("_slice", F.substring("_hash", 1, digits))
    slices = own.groupBy("sid", "_slice").agg(F.sum("_weight").alias("_sum"))
    slices = slices.select("sid", "_slice", (F.sum("_sum").over(Window.partitionBy("sid").orderBy("_slice")) - F.col("_sum")).alias("_slice_before"))
    inside = Window.partitionBy("sid", "_slice").orderBy("_hash", *ties).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_inside", F.sum("_weight").over(inside) - F.col("_weight")).join(slices, ["sid", "_slice"])
    return own.withColumn("_before", F.col("_slice_before") + F.col("_inside")).drop("_hash", "_weight", "_slice", "_slice_before", "_inside")


def placed(sizes: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(_row, id, size, sid, start), stored: where each text of at least one word begins in its source's stream."""
    named = sizes.filter("size > 0").join(sources.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")))
    rows = named.select("_row", "id", "size", "sid")
    hash_ = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    return stored(running(rows, hash_, F.col("size"), sizes.count(), "id", "size").withColumnRenamed("_before", "start"), "placed")


def chosen_blocks(places: DataFrame, sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(sid, block, copy int, shard int): the seats of the mix and the block that fills each.

    A block is made where its first word lies, so a long stream is cut by as many tasks as hold
    its documents. The block at place r of the seeded order fills the seats r + 1, r + 1 + n_blocks
    and so on, as far as the quota goes.
    """
    known = sources.select("sid", "n_blocks", "quota", "target")
    first, last = F.ceil(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    begun = places.join(known, "sid").withColumn("last", F.least(last, F.col("n_blocks") - 1)).filter(first <= F.col("last"))
    blocks = begun.select("sid", "n_blocks", "quota", "target", F.explode(F.sequence(first, F.col("last"))).alias("block"))
    n_blocks = sources.agg(F.sum("n_blocks")).first()[0] or 0
    hash_ = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sid"), F.col("block")))
    order = running(blocks, hash_, F.lit(1), n_blocks, "block").withColumn("seat", F.col("_before") + 1)
    copies = F.floor((F.col("quota") - F.col("seat")) / F.col("n_blocks")).cast("int")
    taken = order.filter(F.col("seat") <= F.col("quota")).withColumn("copy", F.explode(F.sequence(F.lit(0), copies)))
    return taken.select("sid", "block", "copy", shard_of(F.col("seat") + F.col("copy") * F.col("n_blocks"), block, shards).alias("shard"))


def spans(places: DataFrame, blocks: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_row, id, sid, shard, block, copy, first_word, n_words): the words of each text that each seat takes.

    The last block of a stream runs to its end. A block holds as many texts at most as it has words.
    """
    ends = places.join(sources.select("sid", "n_blocks"), "sid")
    of = lambda word: F.least(F.floor(word / block), F.col("n_blocks") - 1)
    end = F.col("start") + F.col("size")
    parts = ends.withColumn("block", F.explode(F.sequence(of(F.col("start")), of(end - 1))))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.when(F.col("block") == F.col("n_blocks") - 1, end).otherwise(F.least(end, (F.col("block") + 1) * block))
    cut = parts.select("_row", "id", "sid", "block", (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))
    return cut.join(blocks, ["sid", "block"]).select("_row", "id", "sid", "shard", "block", "copy", "first_word", "n_words")


def mixed_texts(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, sid, block, copy, id, text): what spans() takes, its words joined by single spaces.

    Ids must be unique and not null here, as they lead to the texts; each text is read once and
    cut where it lies.
    """
    own = taken.groupBy("id").agg(F.collect_list(F.struct("shard", "sid", "block", "copy", "first_word", "n_words")).alias("parts"))
    words = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD), F.lit(0)).alias("words"))
    rows = own.join(words, "id").select("id", "words", F.explode("parts").alias("p"))
    text = F.array_join(F.slice("words", F.col("p.first_word").cast("int") + 1, F.col("p.n_words").cast("int")), " ")
    return rows.select("p.shard", "p.sid", "p.block", "p.copy", "id", text.alias("text"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple = WEIGHTS, share: float = SHARE, copies: int = COPIES, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, spans): the rows with their sizes, the sources with their targets, and what the mix takes.

    A null or empty text has size 0 and is never taken; texts of any length are counted whole and
    taken block by block. A null source is a source of its own, the last. Rows that repeat an id
    are rows of their own, next to each other in the stream; equal ones may swap places. Equal
    hashes are ordered by id, then size. Other columns are not read, whatever their names. An
    empty table gives empty tables. Results depend on the rows and the seed alone.
    """
    sizes = sized(docs, id_col, source_col, text_col)
    sources = targets(sizes, weights, share, copies, block)
    places = placed(sizes, sources, seed)
    return sizes, sources, spans(places, chosen_blocks(places, sources, block, shards, seed), sources, block)


def op13_query(spark, sf_dir: str) -> DataFrame:
    sizes, sources, taken = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    words = taken.groupBy("_row").agg(F.sum("n_words").alias("taken"))
    of = sources.select(F.col("source").alias("_source"), "source_size", "target")
    rows = sizes.join(of, F.col("source").eqNullSafe(F.col("_source"))).join(words, "_row", "left")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


OP13_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][1 + sid % 3] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS most FROM totals),
ladder AS (
  SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), filled AS (
  SELECT sid, source, source_size, least(weight * (SELECT level FROM ladder WHERE weight * level <= most ORDER BY most / weight, sid LIMIT 1), most) AS target FROM weighed
), quotas AS (
  SELECT *, least(CAST(floor(target / {BLOCK} + 0.5) AS BIGINT), {COPIES} * n_blocks) AS quota
  FROM (SELECT *, CASE WHEN source_size > 0 THEN greatest(1, CAST(floor(source_size / {BLOCK} + 0.5) AS BIGINT)) ELSE 0 END AS n_blocks FROM filled)
), placed AS (
  SELECT s.doc_id, s.size, q.sid, q.n_blocks,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY q.sid ORDER BY md5('{SEED}:' || s.doc_id), s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source WHERE s.size > 0
), seats AS (
  SELECT sid, n_blocks, quota, block, row_number() OVER (PARTITION BY sid ORDER BY md5('{SEED}:' || sid || ':' || block), block) AS seat
  FROM (SELECT sid, n_blocks, quota, unnest(range(n_blocks)) AS block FROM quotas)
), times AS (SELECT sid, block, CAST(seat <= quota AS BIGINT) + CAST(seat + n_blocks <= quota AS BIGINT) AS times FROM seats),
parts AS (
  SELECT *, CASE WHEN block = n_blocks - 1 THEN start + size ELSE least(start + size, (block + 1) * {BLOCK}) END - greatest(start, block * {BLOCK}) AS n_words
  FROM (SELECT *, unnest(range(least(start // {BLOCK}, n_blocks - 1), least((start + size - 1) // {BLOCK}, n_blocks - 1) + 1)) AS block FROM placed)
), taken AS (SELECT doc_id, CAST(sum(n_words * times) AS BIGINT) AS taken FROM parts JOIN times USING (sid, block) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM sized JOIN filled ON sized.source IS NOT DISTINCT FROM filled.source LEFT JOIN taken USING (doc_id)
"""
