"""Column functions by hand, and dense search in blocks."""

from pyspark.sql import functions as F

from lorecraft.functions import text as X
from lorecraft.operators import retrieval as R


def test_text_functions(spark):
    d = spark.createDataFrame([("Ｈｅｌｌｏ  the 缓存系统", "abcabcabc", "1-3, 2,8")], "a string, b string, c string")
    t = X.normalize_text(F.col("a"))
    r = d.select(X.terms(t).alias("t"), X.tokens(t).alias("k"), X.collapse_repetition(F.col("b")).alias("r"), X.page_ranges(F.col("c")).alias("p"), X.clean_text(F.col("a")).alias("n")).first()
    assert r.t == ["hello", "缓存", "存系", "系统", "synonym_0"] and r.k == ["hello", "缓存", "存系", "系统"]
    assert r.r == "abc" and r.p == [1, 2, 3, 8] and r.n == "Hello the 缓存系统"


def test_texts_of_cards(spark):
    """Line ends are white space, characters beyond the basic plane are two units, long words of Han are left out."""
    d = spark.createDataFrame([("first line here\nsecond line here. Third one it is", "a  b \U0001f600", "缓存是指一种存储，这是一个超过十个汉字的连续词语 Redis 集群")], "a string, b string, c string")
    r = d.select(X.sentences(F.col("a")).alias("s"), X.hash_text(F.col("b")).alias("h"), X.keywords(F.col("c")).alias("k"), X.compact_title(F.lit(" \u3000 "), "none").alias("t"), X.short_text(F.col("a"), 12).alias("c")).first()
    assert r.s == ["first line here second line here", "Third one it is"] and r.h == 2811303488
    assert r.k == ["缓存是", "Redis", "缓存是指一种存储", "集群"] and r.t == "none" and r.c == "first line …"


def test_dense_blocks_equal_one_block(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    many, one = R.dense(q, v, "vec_id", 0.2, 7, 60), R.dense(q, v, "vec_id", 0.2)
    assert many.count() == one.count() and many.exceptAll(one).count() == 0
