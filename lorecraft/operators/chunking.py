"""Windows, blocks and spans of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, OVERLAP = 360, 40


def sliding_windows(docs: DataFrame, id_col: str, text_col: str, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(id, start, end, text): windows of size characters that overlap; an empty text has none."""
    step = size - overlap
    n = F.length(text_col)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int") * step)
    told = docs.filter(n > 0).select(id_col, F.col(text_col).alias("_text"), F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"))
    cut = F.substring(F.col("_text"), F.col("start") + 1, F.lit(size))
    return told.select(id_col, "start", (F.col("start") + F.length(cut)).alias("end"), cut.alias("text"))


def assembled(blocks: DataFrame, key: str, order: str, text_col: str) -> DataFrame:
    """(key, order, start, end): places of non-empty trimmed blocks in their text, two characters apart."""
    own = blocks.withColumn("_t", F.trim(text_col)).filter(F.length("_t") > 0)
    before = F.sum(F.length("_t") + 2).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return own.select(key, order, F.coalesce(before, F.lit(0)).alias("start"), F.length("_t").alias("_n")).select(key, order, "start", (F.col("start") + F.col("_n")).alias("end"))


def margin_signature(line: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(line, r"[0-9]+", "#"), r"\s+", ""), 1, 160)


def repeated_margins(lines: DataFrame, doc: str, page: str, line: str) -> DataFrame:
    """(doc, signature, pages): signatures on at least two pages and three fifths of a document's pages."""
    own = lines.select(doc, page, margin_signature(F.col(line)).alias("signature")).filter("signature <> ''").distinct()
    per = own.groupBy(doc, "signature").agg(F.count("*").alias("pages"))
    total = lines.groupBy(doc).agg(F.count_distinct(page).alias("n"))
    return per.join(total, doc).filter(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 6 / 10))).select(doc, "signature", "pages")


def expanded(chunks: DataFrame, picked: DataFrame, key: str, order: str, heading: str) -> DataFrame:
    """Chunks that are picked(key, order), and their neighbours under the same heading."""
    marked = chunks.join(picked.select(key, order).distinct().withColumn("hit", F.lit(True)), [key, order], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    w = Window.partitionBy(key).orderBy(order)
    near = lambda f: F.coalesce(f("hit").over(w) & (f(heading).over(w) == F.col(heading)), F.lit(False))
    return marked.withColumn("near", near(F.lag) | near(F.lead)).filter("hit OR near").withColumn("role", F.when(F.col("hit"), "hit").otherwise("neighbour")).drop("hit", "near")


def compacted(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """(key, label, first, last): runs of consecutive numbers with one label."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(key, label).orderBy(order))
    return rows.withColumn("_island", island).groupBy(key, label, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_island")


def sparse(text: Column, least: int = 12) -> Column:
    """Whether too little is left of a page without space, punctuation and digits."""
    return F.length(F.regexp_replace(text, r"[\s\p{P}\p{N}]", "")) < least


def excerpt(text: Column, start: Column, end: Column, around: int = 80) -> dict[str, Column]:
    """before, highlight and after of a span of characters."""
    begin = F.greatest(start - around, F.lit(0))
    return {"before": F.substring(text, begin + 1, start - begin), "highlight": F.substring(text, start + 1, end - start), "after": F.substring(text, end + 1, F.lit(around))}


def violations(blocks: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """blocks(key, start, end, text) that overlap the one before or differ from texts(key, content) at their place."""
    before = F.lag("end").over(Window.partitionBy(key).orderBy("start", "end"))
    told = blocks.withColumn("_before", before).join(texts, key)
    fault = F.when(F.col("_before") > F.col("start"), "overlap").when(F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"), "text_differs")
    return told.select(key, "start", "end", fault.alias("fault")).filter("fault IS NOT NULL")
