"""Commits: whole or nothing, once, in order; and what is built on them."""

import pytest
from pyspark.sql import functions as F

from lorecraft import bindings as B
from lorecraft.operators import index as I
from lorecraft.operators import structure as S
from lorecraft.operators import vectors as V
from lorecraft.operators.rules import HashedBigrams
from lorecraft.sources import commits

SF = "/root/testdata/sf0.001"


def table(spark, *rows):
    return spark.createDataFrame(rows, "id long, v string")


def rows(spark, path, at=None):
    return sorted(map(tuple, commits.read(spark, path, "rows", ["id"], at).collect()))


def test_changes_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert commits.version(spark, path) == 0
    assert commits.upsert(spark, path, "a", table(spark, (1, "x"), (2, "y")), ["id"]) == 1
    assert commits.upsert(spark, path, "b", table(spark, (2, "z"), (3, "w")), ["id"], removed=table(spark, (1, ""), (3, ""))) == 2
    assert rows(spark, path) == [(2, "z")] and rows(spark, path, at=1) == [(1, "x"), (2, "y")]
    # the same change again changes nothing
    assert commits.upsert(spark, path, "a", table(spark, (9, "no")), ["id"]) == 1 and rows(spark, path) == [(2, "z")]
    assert commits.compacted(spark, path, ["rows"], ["id"]) == 3 and rows(spark, path) == [(2, "z")]
    assert commits.upsert(spark, path, "c", table(spark, (1, "back")), ["id"]) == 4 and rows(spark, path) == [(1, "back"), (2, "z")]


def test_a_write_that_dies_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    commits.upsert(spark, path, "a", table(spark, (1, "x")), ["id"])
    broken = table(spark, (2, "y"), (3, "z")).withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("dies"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="dies"):
        commits.upsert(spark, path, "b", broken, ["id"])
    assert commits.version(spark, path) == 1 and rows(spark, path) == [(1, "x")]
    assert commits.upsert(spark, path, "b", table(spark, (2, "y")), ["id"]) == 2 and rows(spark, path) == [(1, "x"), (2, "y")]


def test_one_writer_of_a_version_wins(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    commits.upsert(spark, path, "a", table(spark, (1, "x")), ["id"])
    with pytest.raises(commits.Conflict):
        commits.upsert(spark, path, "b", table(spark, (2, "y")), ["id"], expected=0)
    with pytest.raises(commits.Conflict):
        commits.put(spark, path, {"version": 1, "change": "late", "folder": "nowhere", "base": False})
    assert commits.version(spark, path) == 1 and rows(spark, path) == [(1, "x")]


def test_index_after_an_update_equals_a_rebuild(spark, tmp_path):
    """Windows of structured texts with heading paths; queries with inner terms, without, and with a phrase."""
    heads = ["# Caches\n\nA cache keeps what is read often. It is fast.\n\n## Misses\n\nA miss reads the store.", "# Joins\n\nA join meets rows by keys.\n\n- one\n- two"]
    docs = spark.createDataFrame([(i, f"{heads[i % 2]}\n\nNumber{i} stands here with concatenated words {i}.", i % 3 == 0) for i in range(12)] + [(50, None, False), (51, "", True)], "doc_id long, text string, linked boolean")
    cards = spark.createDataFrame([(1, "Card", "A cache is no store.")], "id long, title string, text string")

    def passages(d):
        told = S.corpus(d, cards, "doc_id", "text")
        return told.select(F.concat("type", F.lit(":"), F.col("owner").cast("string")).alias("owner"), "entry", "type", "linked", F.substring_index("embedding_text", "\n", 1).alias("heading"), F.expr("substring(embedding_text, instr(embedding_text, '\\n') + 1)").alias("text"))

    queries = spark.createDataFrame([(1, "cache misses"), (2, "cat"), (3, "A miss reads"), (4, ""), (5, None), (6, "joins rows of the keys"), (7, "缓存"), (8, "umber5")], "query_id long, query string")
    changed = docs.filter("doc_id in (1, 2)").withColumn("text", F.lit("# New\n\nNothing but cattle and keys here."))
    final = docs.filter("doc_id not in (1, 2, 3)").unionByName(changed)
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    I.build(spark, one, passages(docs))
    gone = spark.createDataFrame([("document:3",)], "owner string")
    for _ in range(2):
        I.update(spark, one, passages(changed).filter("type = 'document'"), gone, "change")
    I.build(spark, two, passages(final))
    found = [sorted(map(str, I.overlaps(queries, *[commits.read(spark, p, n, I.KEY) for n in ("entries", "postings")]).collect())) for p in (one, two)]
    assert found[0] == found[1] and len(found[0]) > 10
    hits = I.overlaps(queries, *[commits.read(spark, one, n, I.KEY) for n in ("entries", "postings")]).collect()
    assert {r.query_id for r in hits} == {1, 2, 3, 6, 7, 8} and all(r.exact for r in hits if r.query_id in (2, 8))
    assert {r.heading for r in hits if r.query_id == 3} == {"Caches / Misses"}


def test_overlap_search_equals_all_pairs(spark, tmp_path):
    from lorecraft.plans import index as P

    docs = B.documents(spark, SF).select("doc_id", "text")
    path = f"file://{tmp_path}/i"
    I.build(spark, path, P.passages(spark, SF, docs))
    entries, postings = (commits.read(spark, path, n, I.KEY) for n in ("entries", "postings"))
    queries = B.queries(spark, SF)
    own = I.wanted(queries)
    every = I.scored(entries.withColumnRenamed("terms", "found").crossJoin(own), 0.18)
    got = I.overlaps(queries, entries, postings)
    assert got.count() == every.count() and got.drop("matched").exceptAll(every.drop("matched")).count() == 0


def test_vectors_in_batches_of_eight(spark, tmp_path):
    class Counting(HashedBigrams):
        def embed(self, texts):
            assert 0 < len(texts) <= V.BATCH
            return super().embed(texts)

    entries = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(50, None), (3, "text 3")], "id long, text string").coalesce(1)
    path = f"file://{tmp_path}/v"
    V.fill(spark, path, entries, "a", Counting())
    V.fill(spark, path, entries, "b", Counting())
    told = V.stored(spark, path).collect()
    assert sorted(r.id for r in told) == list(range(50)) and sorted(r.batch_rows for r in told)[-48:] == [8] * 48
    V.fill(spark, path, entries, "c", HashedBigrams(16))
    V.prune(spark, path, entries.filter("id < 10"), "d", HashedBigrams(16))
    assert sorted((r.id, len(r.vector)) for r in V.stored(spark, path).collect()) == [(i, 16) for i in range(10)]


def test_a_model_that_fails_stores_nothing(spark, tmp_path):
    class Broken(HashedBigrams):
        def embed(self, texts):
            return [[0.0] for _ in texts]

    with pytest.raises(Exception, match="another shape"):
        V.fill(spark, f"file://{tmp_path}/v", spark.createDataFrame([(1, "a")], "id long, text string"), "a", Broken())
    assert not V.stored(spark, f"file://{tmp_path}/v").collect()


def test_searches_shuffle_no_text_and_read_any_version(spark, tmp_path, monkeypatch):
    """Blocks of queries of any size; entries and postings of all versions with what holds, and those that are live."""
    texts = ["a cache keeps what is read often", "joins meet rows by keys and a cache", "缓存 holds rows", "", "nothing of the kind", "rows rows rows"]
    docs = spark.createDataFrame([(i, 0, "document", True, "h", f"{texts[i % 6]} {i}") for i in range(30)], "owner long, entry int, type string, linked boolean, heading string, text string")
    path = f"file://{tmp_path}/i"
    I.build(spark, path, docs)
    I.update(spark, path, docs.filter("owner % 4 = 0").withColumn("text", F.lit("a new cache of rows")), docs.filter("owner % 7 = 0").select("owner"), "change")
    queries = spark.createDataFrame([(1, "cache rows"), (2, "ache"), (3, "meet rows by"), (4, "absent"), (5, "缓存"), (6, "kin"), (7, None), (1, "cache rows")], "query_id long, query string")
    live = [commits.read(spark, path, n, I.KEY) for n in ("entries", "postings")]
    want = {tuple(map(str, r)) for r in I.scored(live[0].withColumnRenamed("terms", "found").crossJoin(I.wanted(queries.dropDuplicates(["query_id"]))), 0.18).collect()}
    whole = [commits.every(spark, path, n) for n in ("entries", "postings")]
    for queries_at_once, rows_at_once in ((2000, 1000), (2, 3)):
        monkeypatch.setattr(I, "QUERIES", queries_at_once)
        monkeypatch.setattr(I, "ROWS", rows_at_once)
        for hits in (I.overlaps(queries, *live), I.overlaps(queries, *whole, holding=commits.holding(spark, path, I.KEY))):
            got = [tuple(map(str, r)) for r in hits.collect()]
            assert set(got) == want and len(got) == len(want) > 10
    plan = I.overlaps(queries, *whole)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
    one = I.overlaps(spark.createDataFrame([(9, "absent")], "query_id long, query string"), *live)
    assert not one.collect()
