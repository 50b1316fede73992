"""Structure of Markdown texts: blocks, heading paths, packed paragraphs, chunks and the corpus made of them.

A text is cut in the task that reads it, by one pass over its lines; offsets count characters.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorecraft.operators.chunking import sliding_windows

# Characters of a chunk, of a heading in front of a window, and of an analysis batch.
CHUNK, HEADING, BATCH = 1800, 80, 6000
_LINE = re.compile(r"[^\n]*\n|[^\n]+\Z")
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_TABLE = re.compile(r"\s*\|.*\|\s*")
_BREAK = re.compile(r"[。！？；\n]|[.!?;]\s")


def line_kinds(text: str) -> Iterator[tuple[int, int, str, object]]:
    """(start, end, kind, detail) of every line: the heading's level and title, or the number of the fence."""
    fence, fences = None, 0
    for m in _LINE.finditer(text):
        line = m.group()
        mark = _FENCE.match(line)
        if fence is not None:
            yield m.start(), m.end(), "code", fences
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
        elif heading := _HEADING.fullmatch(line.rstrip()):
            yield m.start(), m.end(), "heading", (len(heading[1]), heading[2])
        elif not line.strip():
            yield m.start(), m.end(), "blank", None
        elif mark:
            fence, fences = mark[1], fences + 1
            yield m.start(), m.end(), "code", fences
        else:
            yield m.start(), m.end(), "table" if _TABLE.fullmatch(line.rstrip()) else "paragraph", None


def blocks(text: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, kind, heading path): neighbouring lines of one kind, each heading by itself."""
    out, path = [], {}
    for (kind, detail), own in itertools.groupby(line_kinds(text), key=lambda x: (x[2], x[3] if x[2] == "code" else x[0] if x[2] == "heading" else None)):
        own = list(own)
        if kind == "blank":
            continue
        if kind == "heading":
            level, title = own[0][3]
            path = {k: v for k, v in path.items() if k < level} | {level: title}
        out.append((own[0][0], own[-1][1], kind, tuple(v for _, v in sorted(path.items()))))
    return out


def packed(found: list[tuple], most: int = CHUNK) -> list[tuple]:
    """Blocks where paragraphs under one heading are joined as long as they fit a chunk."""
    out: list[tuple] = []
    for b in found:
        if out and out[-1][2] == b[2] == "paragraph" and out[-1][3] == b[3] and b[1] - out[-1][0] <= most:
            out[-1] = (out[-1][0], b[1], *b[2:])
        else:
            out.append(b)
    return out


def cuts(text: str, start: int, end: int, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Spans of at most `most` characters that end behind the last sentence, if that is past the half."""
    while start < end:
        stop = min(start + most, end)
        if stop < end:
            last = None
            for last in _BREAK.finditer(text, start, stop):
                pass
            if last and last.start() - start > most / 2:
                stop = last.end()
        yield start, stop
        start = stop


def _told(docs: DataFrame, id_col: str, text_col: str, rows) -> DataFrame:
    """A row (start, end, kind, heading_path, block) for each span that rows(text) gives."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, *r[:3], list(r[3]), r[4]) for i, text in zip(pdf["id"], pdf["text"]) for r in rows(text or "")]
            yield pd.DataFrame(out, columns=["id", "start", "end", "kind", "heading_path", "block"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInPandas(run, f"id {kind}, start int, end int, kind string, heading_path array<string>, block int").withColumnRenamed("id", id_col)


def structure_blocks(docs: DataFrame, id_col: str, text_col: str, join: bool = False) -> DataFrame:
    """(id, start, end, kind, heading_path, block): the blocks of each text, with joined paragraphs if asked for."""
    return _told(docs, id_col, text_col, lambda t: [(*b, b[0]) for b in (packed(blocks(t)) if join else blocks(t))])


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chunk, start, end, kind, heading_path, block): chunk is {id}_chunk_{start}; null and blank texts have none."""
    told = _told(docs, id_col, text_col, lambda t: [(s, e, b[2], b[3], b[0]) for b in packed(blocks(t)) for s, e in cuts(t, b[0], b[1])])
    return told.withColumn("chunk", F.concat(F.col(id_col).cast("string"), F.lit("_chunk_"), F.col("start").cast("string")))


def linked(docs: DataFrame, cited: DataFrame, id_col: str) -> DataFrame:
    """docs with `linked`: whether any card cites the document."""
    return docs.join(cited.select(id_col).distinct().withColumn("_l", F.lit(True)), id_col, "left").withColumn("linked", F.coalesce("_l", F.lit(False))).drop("_l")


def in_scope(entries: DataFrame, kind: str | None = None, exclude: int | None = None, only_linked: bool = False) -> DataFrame:
    """Entries that a search may see; applied before anything is counted or scored."""
    if kind:
        entries = entries.filter(F.col("type") == kind)
    if exclude is not None:
        entries = entries.filter(~F.col("owner").eqNullSafe(F.lit(exclude)) | (F.col("type") != "document"))
    return entries.filter("linked") if only_linked else entries


def corpus(docs: DataFrame, cards: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(entry, type, owner, role, linked, embedding_text): windows over the chunks of documents and over whole cards.

    docs(id, text, linked), cards(id, title, text). Headings give no entry of their own; their
    path, 80 characters at most, stands before the window's text.
    """
    texts = docs.select(id_col, F.col(text_col).alias("_text"), "linked")
    body = chunks(docs, id_col, text_col).filter("kind <> 'heading'").join(texts, id_col)
    cut = body.select(id_col, "linked", F.col("start").alias("at"), F.substring(F.array_join("heading_path", " / "), 1, HEADING).alias("head"), F.substring(F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    keyed = cut.withColumn("_key", F.struct(id_col, "linked", "at", "head"))
    own = sliding_windows(keyed, "_key", "text")
    entry = lambda kind, c, at: F.concat(F.lit(f"{kind}:"), c.cast("string"), F.lit(":"), at.cast("string")).alias("entry")
    text = lambda head: F.concat(head, F.lit("\n"), F.col("text")).alias("embedding_text")
    d = own.select(entry("document", F.col(f"_key.{id_col}"), F.col("_key.at") + F.col("start")), F.lit("document").alias("type"), F.col(f"_key.{id_col}").alias("owner"), F.lit("source_excerpt").alias("role"), F.col("_key.linked").alias("linked"), text(F.col("_key.head")))
    c = sliding_windows(cards.withColumn("_key", F.struct("id", "title")), "_key", "text")
    c = c.select(entry("card", F.col("_key.id"), F.col("start")), F.lit("card").alias("type"), F.col("_key.id").alias("owner"), F.lit("learning_background").alias("role"), F.lit(False).alias("linked"), text(F.substring(F.coalesce("_key.title", F.lit("")), 1, HEADING)))
    return d.unionByName(c)


def batches(pieces: DataFrame, key: str, order: str, size: str, budget: int = BATCH) -> DataFrame:
    """pieces with `batch`, from 0: in order, as many as fit the budget; a larger piece is a batch of its own.

    The sizes of one key, a number for each piece, are folded in one array.
    """
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("n"))))
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("all"))

    def step(state, x):
        fresh = (state["b"] < 0) | (state["used"] + x["n"] > budget)
        b = F.when(fresh, state["b"] + 1).otherwise(state["b"])
        return F.struct(b.alias("b"), F.when(fresh, x["n"]).otherwise(state["used"] + x["n"]).alias("used"), F.array_append(state["all"], b).alias("all"))

    folded = pieces.groupBy(key).agg(own.alias("own")).select(key, "own", F.aggregate("own", start, step)["all"].alias("all"))
    told = folded.select(key, F.explode(F.arrays_zip("own", "all")).alias("z"))
    return told.select(key, F.col("z.own.o").alias(order), F.col("z.all").alias("batch"))


def selected_blocks(found: DataFrame, wanted: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """(key, blocks, characters, fault): blocks that are asked for by id; a missing one or too many characters is a fault."""
    told = wanted.join(found, [key, "block"], "left")
    missing, characters = F.count_if(F.col("length").isNull()), F.coalesce(F.sum("length"), F.lit(0))
    fault = F.when(missing > 0, "missing").when(characters > most, "too_long")
    return told.groupBy(key).agg(F.count("length").alias("blocks"), characters.alias("characters"), fault.alias("fault"))


def budget_fit(pairs: DataFrame, size: str, most: int, budget: int) -> DataFrame:
    """The newest pairs that stay when the oldest go until `most` are left and their sizes fit the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.col("user_turn").desc())
    told = pairs.withColumn("back", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.filter((F.col("back") <= most) & (F.col("used") <= budget)).drop("used")
