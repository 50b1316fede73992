"""Line dedup: first occurrences of repeated lines, told as per-document bitmaps.

Line keys are hashed, dealt by ranges of the hash and sorted inside by document and
position; a running window streams over each key and knows the first document that holds
it. The lines that go are returned as bit words of 64 lines for each document, so no text
moves until the bitmaps are applied. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, heavy_rows, lower_ascii, stored

MIN_KEY_CHARS = 10


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def digest(value: Column) -> Column:
    """128 bits of SHA-256, as hexadecimal characters."""
    return F.substring(F.sha2(value, 256), 1, 32)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row, pos, line_hash) of the lines whose key has min_chars code points or more.

    row tells rows with one id and different texts apart.
    """
    lines = docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")
    ).withColumn("key", line_key("line"))
    return lines.filter(F.length("key") >= min_chars).select("id", "row", "pos", digest("key").alias("line_hash"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """The rows (id, row, pos) of lines whose hash a smaller id holds; a null id comes last.

    Hashes are range-partitioned with a secondary sort by id and position, and the first id
    of each is streamed along. Hashes with a HEAVY_KEYS-th of the rows or more, of which there
    are so many at most, are pre-aggregated and resolved by a broadcast.
    """
    counts = lines.groupBy("line_hash").agg(F.count("*").alias("n"), F.min("id").alias("heavy_first"))
    heavy = heavy_rows(counts, "n", lines.count()).select("line_hash", "heavy_first", F.lit(True).alias("heavy"))
    told = lines.join(F.broadcast(heavy), "line_hash", "left")
    hot = told.filter("heavy").withColumn("first_id", F.col("heavy_first"))
    stream = Window.partitionBy("line_hash").orderBy(F.col("id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, 0)
    rest = told.filter("heavy IS NULL").repartitionByRange("line_hash").withColumn("first_id", F.first("id").over(stream))
    later = (F.col("first_id") < F.col("id")) | (F.col("first_id").isNotNull() & F.col("id").isNull())
    return hot.unionByName(rest).filter(later).select("id", "row", "pos")


def drop_bitmaps(gone: DataFrame) -> DataFrame:
    """(id, row, words, n_dropped): the 64-line words that lose a line, as struct(word, bits).

    Words that lose none are left out, so a bitmap is never larger than what goes.
    """
    words = gone.groupBy("id", "row", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("id", "row").agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped")
    )


def kept_lines(text: Column, words: Column) -> Column:
    """The lines of text whose bit is not set in words."""
    before = lambda i: F.when(i > 0, F.get(words, i - 1)["word"]).otherwise(F.lit(-1))
    dense = F.flatten(
        F.transform(words, lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("long"), x["word"] - before(i) - 1), F.array(x["bits"])))
    )
    holder = F.transform(
        F.array(F.struct(F.split(text, "\n").alias("lines"), dense.alias("bits"))),
        lambda h: F.filter(
            h["lines"], lambda _, i: F.coalesce(F.get(h["bits"], F.shiftright(i, 6)), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)) == 0
        ),
    )
    return F.get(holder, F.lit(0))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS) -> tuple[DataFrame, DataFrame]:
    """(kept, bitmaps): docs with repeated lines cut from text_col, and what drop_bitmaps returns.

    kept has all columns of docs and `n_lines`, `n_dropped` (long) after them. Lines split
    at newline; a null or empty text is one empty line and comes back as it was. Keys under
    min_chars code points stay. Rows that repeat an id count as one document, and a null id
    as one that comes after all others. All lines of a document may go, which leaves an
    empty text. An empty table gives empty tables; other columns pass through, whatever
    their names (`n_lines` and `n_dropped` of docs are replaced).
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = stored(line_hashes(docs, id_col, text_col, min_chars), "lines")
    bitmaps = drop_bitmaps(repeated_lines(lines))
    d = docs.select(F.struct(*own).alias("doc"), F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_row"))
    both = d.join(bitmaps, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_row") == F.col("row")), "left")
    text = F.col("doc")[text_col]
    cut = F.when(F.col("words").isNull(), text).otherwise(F.array_join(kept_lines(text, F.col("words")), "\n"))
    n_lines = F.coalesce(F.size(F.split(text, "\n")), F.lit(1)).cast("long")
    kept = both.select(
        *[cut.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in own],
        n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
    )
    return kept, bitmaps


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept, _ = dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE f.first_doc < l.doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE f.first_doc IS NULL OR f.first_doc >= l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN firsts f ON l.k = f.k GROUP BY l.doc_id
"""
