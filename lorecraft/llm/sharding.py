"""Sharding by balanced label propagation.

Documents are the nodes of a graph whose links join equal texts; every shard is a label. In
each round a document looks at its neighbours' labels, told by one histogram for each group
instead of by pairs, and moves to the shard where most of them are, as far as the capacity
left there allows. Rounds are joins and aggregations over written tables. In the end shard
sizes are made exact by moving the documents without links, which cut nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_heavy, stored

SHARDS = 24
ROUNDS = 3
#: Buckets in which places within a shard are counted: of linked groups, and as many again for the rest.
BUCKETS = 4096
#: A group larger than this share of a shard is admitted document by document, a smaller one as a whole.
WHOLE_GROUP = 0.02


def share(key: Column, salt: int) -> Column:
    """A hash of key as a number from 0 to 1."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(1 << 30)


def pick(values: list[int], index: Column) -> Column:
    """values[index], for one value of each shard."""
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), index)


def propagate(nodes: DataFrame, groups: DataFrame, shards: int, turn: int) -> DataFrame:
    """One round over nodes(node, grp, ..., shard), where groups(grp, n) are those of two rows or more.

    Every group's histogram of labels gives the label that most members have, among those with
    room for the others if there are such (the smaller label on a tie). Of the members elsewhere
    that want to move there, so large a share is admitted as there is room beside those that stay.
    """
    total = nodes.count()
    capacity = -(-total // shards)
    linked = nodes.filter("n > 1")
    histogram = stored(linked.groupBy("grp", "shard").agg(F.count("*").alias("members")), "histogram")
    held = {r["shard"]: r["held"] for r in histogram.groupBy("shard").agg(F.sum("members").alias("held")).collect()}  # a row for each shard
    room = pick([capacity - held.get(s, 0) for s in range(shards)], F.col("shard"))
    choice = F.struct((room >= F.col("n") - F.col("members")).alias("fits"), F.col("members"), (-F.col("shard")).alias("s"))
    wanted = histogram.join(groups, "grp").groupBy("grp", "n").agg(F.max(choice)["s"].alias("s"))
    wanted = stored(wanted.select("grp", (-F.col("s")).alias("want"), "n"), "wanted")
    moving = histogram.join(wanted, "grp")
    flows = moving.groupBy("want").agg(
        F.sum(F.when(F.col("shard") == F.col("want"), F.col("members")).otherwise(0)).alias("stay"),
        F.sum(F.when(F.col("shard") != F.col("want"), F.col("members")).otherwise(0)).alias("demand"),
    )
    by = {r["want"]: r for r in flows.collect()}  # a row for each shard
    admit = [min(1.0, max(0, capacity - by[s]["stay"]) / by[s]["demand"]) if s in by and by[s]["demand"] else 1.0 for s in range(shards)]
    told = join_heavy(nodes, wanted.select("grp", "want", F.col("n").alias("members")), "grp", "members", total)
    drawn = F.when(F.col("members") > WHOLE_GROUP * capacity, share(F.col("node"), turn)).otherwise(share(F.col("grp"), turn))
    room = F.get(F.array(*[F.lit(float(a)) for a in admit]), F.col("want"))
    moved = F.when(F.col("want").isNotNull() & (F.col("want") != F.col("shard")) & (drawn < room), F.col("want")).otherwise(F.col("shard"))
    return stored(told.withColumn("shard", moved).drop("want", "members"), "round")


def placed(nodes: DataFrame) -> DataFrame:
    """nodes with place (long): gapless from 0 in each shard, linked groups first and together.

    Places are counted in BUCKETS buckets of a shard, into which a group is dealt by its hash
    and a sixteenth of its rows by theirs, so no bucket holds more than a small part of a shard.
    """
    sub = F.pmod(F.xxhash64("node"), F.lit(16))
    linked = F.pmod(F.xxhash64("grp"), F.lit(BUCKETS // 16)) * 16 + sub
    single = BUCKETS + F.pmod(F.xxhash64("node"), F.lit(BUCKETS))
    bucketed = stored(nodes.withColumn("bucket", F.when(F.col("n") > 1, linked).otherwise(single)), "bucketed")
    counts = bucketed.groupBy("shard", "bucket").agg(F.count("*").alias("rows_in"))
    before = F.sum("rows_in").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("grp", "node")) - 1
    return bucketed.withColumn("within", within).join(starts, ["shard", "bucket"]).withColumn("place", F.col("start") + F.col("within")).drop("bucket", "start", "within")


def levelled(nodes: DataFrame, shards: int) -> DataFrame:
    """nodes with shard and slot, where counts are at most one apart: those placed beyond a shard's share fill the gaps of others."""
    own = stored(placed(nodes), "placed")
    have = {r["shard"]: r["count"] for r in own.groupBy("shard").count().collect()}  # a row for each shard
    total = sum(have.values())
    counts = [have.get(s, 0) for s in range(shards)]
    # the larger shares go to the shards that are fullest already
    larger = set(sorted(range(shards), key=lambda s: (-counts[s], s))[: total % shards])
    quota = [total // shards + (s in larger) for s in range(shards)]
    over = [max(0, c - q) for c, q in zip(counts, quota)]
    gaps = [max(0, q - c) for c, q in zip(counts, quota)]
    first_over = [sum(over[:s]) for s in range(shards)]
    ends = [sum(gaps[: s + 1]) for s in range(shards)]
    excess = F.col("place") - pick(quota, F.col("shard"))
    rank = pick(first_over, F.col("shard")) + excess
    target = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= rank))
    out = own.withColumn("to", F.when(excess < 0, F.col("shard")).otherwise(target.cast("int")))
    begin = [ends[s] - gaps[s] for s in range(shards)]
    slot = F.when(excess < 0, F.col("place")).otherwise(pick(counts, F.col("to")) + rank - pick(begin, F.col("to")))
    return out.withColumn("slot", slot.cast("long")).drop("shard", "place").withColumnRenamed("to", "shard")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of docs: id_col, size, text_crc32, law, shard, slot, grown_shard, linked.

    The law is `rows`: counts of shards differ by one at most. Documents of equal texts are
    linked (a null text is an empty one) and stay together as far as shards have room; a group
    larger than a shard fills several. size is the UTF-8 bytes of the text plus 8. grown_shard
    is null under this law; linked tells whether another row has the same text. Null ids and
    repeated rows are rows like others. Other columns are not read. An empty table gives an
    empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.substring(F.sha2(text, 256), 1, 32).alias("grp"), F.monotonically_increasing_id().alias("node"),
    )
    rows = stored(rows, "nodes")
    total = rows.count()
    groups = stored(rows.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    nodes = join_heavy(rows, groups, "grp", "n", total).withColumn("n", F.coalesce("n", F.lit(1)))
    nodes = stored(nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "labels")
    for turn in range(rounds):
        nodes = propagate(nodes, groups, shards, turn)
    out = levelled(nodes, shards)
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), (F.col("n") > 1).alias("linked")
    )


def cut_links(sharded: DataFrame, key: str) -> DataFrame:
    """(n_groups, cut_groups): groups of equal key, and those that lie in several shards."""
    by = sharded.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("shard").alias("in_shards")).filter("n > 1")
    return by.agg(F.count("*").alias("n_groups"), F.count_if(F.col("in_shards") > 1).alias("cut_groups"))


def op9_query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
