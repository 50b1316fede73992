"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and its
result is written as Parquet and read again as the docs of the next one. All stages but the
last return the columns of documents, with n_chars brought up to date where text is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecraft.llm import langid, line_dedup, minhash, packing, substring_dedup
from lorecraft.llm.common import drop_stored, settled, stored  # noqa: F401

#: Documents whose language is less certain than this are rejected.
MIN_LANGUAGE_SCORE = 0.5
#: Percent of shared shingles from which documents count as near copies: looser than the 85 of
#: the query, as texts have lost their repeated lines by then.
NEAR_COPY = 80


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted again."""
    length = F.length("text").cast("long")
    return docs.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in columns])


def aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names out of the way of an operator's own ones, and the names to put back."""
    back = {f"_own_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with some certainty.

    Null and empty texts and those without a letter go; long texts are read whole; repeated rows
    are told apart by nothing and stay or go together; a tie of languages is told as any other
    prediction. All columns come back with their values, whatever their names. An empty table
    gives an empty table.
    """
    model = langid.fit(docs.select("doc_id", "lang", "text"))
    held, back = aside(docs, ("lang_pred", "score"))
    told = langid.identify(held, model)
    return told.filter((F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).drop("lang_pred", "score").withColumnsRenamed(back).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every line that a smaller doc_id holds; a document of nothing else goes.

    A null text is one empty line and stays null. Rows that share a doc_id keep the same lines.
    Rows with a null doc_id, long texts, ties, other columns and an empty table: as in dedup_lines;
    columns that have the names of its results keep their own values.
    """
    held, back = aside(docs, ("n_lines", "n_dropped"))
    kept, _ = line_dedup.dedup_lines(held)
    return with_length(kept.filter((F.col("n_dropped") == 0) | (F.length("text") > 0)).drop("n_lines", "n_dropped").withColumnsRenamed(back), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest doc_id.

    Documents without words and rows with a null doc_id stay. Rows that repeat a doc_id stay or
    go together. Other columns come back as they are; an empty table gives an empty table.
    """
    near = lambda: minhash.near_dedup(docs.select("doc_id", "text"), threshold=NEAR_COPY).filter(~F.col("kept")).select("doc_id").distinct()
    gone = settled(spark, near, "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 50 words or more that a smaller doc_id holds too; a document of nothing else goes.

    Null and empty texts, short ones and rows with a null doc_id stay as they are. Rows that
    repeat a doc_id are cut at the same words. Other columns come back as they are; an empty
    table gives an empty table.
    """
    spans = settled(spark, lambda: substring_dedup.repeated_passages(docs.select("doc_id", "text")), "spans")
    return with_length(substring_dedup.cut_passages(docs, spans, drop_emptied=True), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its token ids, its sequence and place in it.

    The ids of a sequence's pieces in the order of their offsets are what a trainer reads
    (packing.sequences joins them), so the product needs none of the tables before it.

    A null text is an empty one; long texts are cut into pieces; repeated rows are documents of
    their own. Other columns are not read; an empty table gives an empty table.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), with_ids=True)


STAGES = [
    ("language", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("substring_dedup", passages),
    ("packing", packed),
]

#: SQL can't express language models, passages or packing; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents of a folder; nothing else is left of what the stages wrote."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        try:
            docs = settled(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        finally:
            drop_stored(before)
        before = docs
    return docs
