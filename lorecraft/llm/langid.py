"""Language ID: word-first backoff.

Known words score by their log frequency in each language; a word that was never seen falls
back to its character n-grams, the longest first, and to shorter ones where those are
unknown too. The counts come from Spark aggregations over labelled rows; the tables that are
broadcast to score have a fixed bound.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bounds of the model: labelled rows for each language that it is fitted on, words and
#: n-grams of each length for each language that it keeps, the most frequent first.
TRAIN_ROWS, MAX_WORDS, MAX_GRAMS = 4000, 30_000, 10_000
MAX_GRAM = 4
UNDECIDED = "und"
#: Confidence: the mean log-odds of a word is counted for so many words at most.
SCORE_WORDS = 20
#: Chunks of text that a task remembers with their scores, and bytes of the longest one of them.
REMEMBERED, REMEMBERED_BYTES = 150_000, 100
#: Texts, and words or chunks, that are scored together.
SLICE, SLICE_WORDS = 512, 16_384

#: Words, as in the training query.
LETTERS = regex.compile(r"\p{L}+")


def sampled(labelled: DataFrame, lang_col: str, id_col: str, rows: int) -> DataFrame:
    """About `rows` rows of each language, chosen by a hash of the id; all of them where there are fewer."""
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return labelled.limit(0)
    share = reduce(
        lambda c, kv: c.when(F.col(lang_col) == kv[0], F.lit(rows / kv[1])), sorted(counts.items())[1:],
        F.when(F.col(lang_col) == min(counts), F.lit(rows / counts[min(counts)])),
    )
    return labelled.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1_000_000)) < share * 1_000_000)


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> dict:
    """The model: languages and, for words and n-grams of each length, {key: array of log frequencies}.

    Learns from rows whose language, text and id are not null. Whole texts are counted by Spark;
    what comes to the driver is bounded by languages x (MAX_WORDS + MAX_GRAM x MAX_GRAMS) counts.
    """
    docs = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    docs = sampled(docs, lang_col, id_col, rows)
    words = docs.select(F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("key"))
    words = words.groupBy("lang", "key").agg(F.count("*").alias("n"))
    letters = words.select("lang", F.split(F.concat(F.lit("^"), F.col("key"), F.lit("$")), "").alias("c"))
    places = lambda n: F.filter(F.sequence(F.lit(0), F.size("c")), lambda i: i + n <= F.size("c"))
    own = lambda n: F.transform(places(n), lambda i: F.concat(*[F.get(F.col("c"), i + k) for k in range(n)]))
    grams = F.flatten(F.array(*[own(n) for n in range(1, MAX_GRAM + 1)]))
    # n-grams come from distinct words, so that a few frequent words don't drown the others
    counted = letters.select("lang", F.explode(grams).alias("key")).filter("key <> ''").groupBy("lang", "key").agg(F.count("*").alias("n"))
    tables = stored(words.withColumn("size", F.lit(0)).unionByName(counted.withColumn("size", F.length("key"))), "counts")
    totals = tables.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect()  # a row for each language and length
    sums = {(r["lang"], r["size"]): r["total"] for r in totals}
    langs = sorted({lang for lang, _ in sums})
    model: dict = {"langs": langs, **{size: {} for size in range(MAX_GRAM + 1)}}
    if not langs:
        return model
    place = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.col("n").desc(), "key"))
    bound = F.when(F.col("size") == 0, MAX_WORDS).otherwise(MAX_GRAMS)
    table = tables.withColumn("place", place).filter((F.col("place") <= MAX_WORDS) & (F.col("place") <= bound)).toPandas()
    for size, own in table.groupby("size"):
        # a key that a language lacks counts as half an occurrence
        floor = np.array([math.log(0.5 / max(1, sums.get((lang, size), 1))) for lang in langs])
        scores: dict[str, np.ndarray] = {}
        for lang, key, n in zip(own["lang"], own["key"], own["n"]):
            k = langs.index(lang)
            scores.setdefault(key, floor.copy())[k] = math.log(n / sums[(lang, size)])
        model[int(size)] = {k: (v - v.max()).astype(np.float32) for k, v in scores.items()}
    return model


def word_scores(model: dict, word: str) -> 'np.ndarray | None':
    """Log scores of a word by language, the best 0; None where not even a letter is known."""
    known = model[0].get(word)
    if known is not None:
        return known
    padded = f"^{word}$"
    for size in range(MAX_GRAM, 0, -1):
        found = [s for i in range(len(padded) - size + 1) if (s := model[size].get(padded[i : i + size])) is not None]
        if found:
            mean = np.sum(found, axis=0)
            return mean - mean.max()
    return None


def gram_keys(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key for the n-gram of `size` code points that begins at each place."""
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        # three code points fit exactly; the fourth is mixed in
        out = out * np.uint64(1 << 21 if k < 3 else 0x9E3779B97F4A7C15) + codes[k : k + n]
    return out


def compact(model: dict) -> dict:
    """The model as one text of keys and one matrix for each length, which a worker holds in little memory."""
    width = len(model["langs"])
    return {"langs": model["langs"], **{size: ("\n".join(model[size]), np.array(list(model[size].values()), np.float32).reshape(len(model[size]), width)) for size in range(MAX_GRAM + 1)}}


class WordScores:
    """A compact model as arrays, which score many words together; the same values as word_scores."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        keys, scores = model[0]
        self.row = {w: i for i, w in enumerate(keys.split("\n"))} if keys else {}
        self.words = np.concatenate([scores, np.zeros((1, len(self.langs)), np.float32)])
        self.grams = {}
        for size in range(1, MAX_GRAM + 1):
            keys, scores = model[size]
            # n-grams of one length are one array of code points
            codes = code_points(keys + "\n").reshape(-1, size + 1)[:, :size] if keys else np.zeros((0, size), np.uint64)
            own = np.zeros(len(codes), np.uint64)
            for k in range(size):
                own = own * np.uint64(1 << 21 if k < 3 else 0x9E3779B97F4A7C15) + codes[:, k]
            order = np.argsort(own)
            self.grams[size] = own[order], scores[order]

    def of(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; zeros where not even a letter is known."""
        rows = np.fromiter((self.row.get(w, -1) for w in words), np.int64, len(words))
        out = self.words[rows].astype(np.float64)
        unseen = np.flatnonzero(rows < 0)
        for at in range(0, len(unseen), SLICE_WORDS):
            own = unseen[at : at + SLICE_WORDS]
            out[own] = self.backed_off([words[i] for i in own.tolist()])
        return out

    def backed_off(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        codes = code_points("".join(f"^{w}$" for w in words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        todo = np.ones(len(words), bool)
        for size in range(MAX_GRAM, 0, -1):
            known, scores = self.grams[size]
            if not len(known) or len(codes) < size:
                continue
            keys = gram_keys(codes, size)
            own = word[: len(keys)]
            at = np.searchsorted(known, keys)
            hit = (known[np.minimum(at, len(known) - 1)] == keys) & todo[own] & (np.arange(len(keys)) + size <= ends[own])
            of, at = own[hit], at[hit]
            if not len(of):
                continue
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total = np.add.reduceat(scores[at].astype(np.float64), starts, axis=0)
            out[of[starts]] = total - total.max(axis=1, keepdims=True)
            todo[of[starts]] = False
        return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class ChunkScores:
    """Sums over texts: chunks between white space are scored once each, the sums of their words' scores and their number."""

    def __init__(self, model: dict):
        self.scores = WordScores(model)
        self.width = len(model["langs"]) + 1
        self.forget()

    def forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((0, self.width))

    def learn(self, new: list[bytes]) -> None:
        chunks = b" ".join(new).decode("utf-8", "replace").lower().split(" ")
        words, counts = [], np.zeros(len(new), np.int64)
        for i, chunk in enumerate(chunks):
            own = [chunk] if chunk.isalpha() else LETTERS.findall(chunk)
            counts[i] = len(own)
            words += own
        rows = np.zeros((len(new), self.width))
        some = np.flatnonzero(counts)
        if len(some):
            rows[some, :-1] = np.add.reduceat(self.scores.of(words), (np.cumsum(counts) - counts)[some], axis=0)
        rows[:, -1] = counts
        first = len(self.table)
        self.row.update(zip(new, range(first, first + len(new))))
        self.table = np.concatenate([self.table, rows])

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """The sum of the rows of all chunks of each text; white space never lies inside a word."""
        chunks = [t.split() for t in texts]
        if len(self.row) > REMEMBERED:
            self.forget()
        new = set().union(*chunks) - self.row.keys()
        if new:
            self.learn(list(new))
        out = np.zeros((len(texts), self.width))
        for i, own in enumerate(chunks):
            rows = np.fromiter(map(self.row.__getitem__, own), np.int64, len(own))
            for at in range(0, len(rows), SLICE_WORDS):
                out[i] += self.table[rows[at : at + SLICE_WORDS]].sum(axis=0)
        for chunk in [c for c in new if len(c) > REMEMBERED_BYTES]:
            del self.row[chunk]
        return out


def scorer(broadcast) -> callable:
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chunks = ChunkScores(broadcast.value)
        langs = broadcast.value["langs"]
        for column in columns:
            parts = [np.zeros((0, len(langs) + 1))]
            for at in range(0, len(column), SLICE):
                parts.append(chunks.totals([t.as_py() or b"" for t in column.slice(at, SLICE)]))
            total = np.concatenate(parts)
            n = total[:, -1]
            names, score = pa.array([UNDECIDED] * len(column), pa.string()), np.zeros(len(column))
            if langs:
                best = total[:, :-1].argmax(axis=1)
                odds = total[:, :-1] - total[np.arange(len(column)), best][:, None]
                score = np.where(n > 0, 1 / np.exp(odds * (np.minimum(n, SCORE_WORDS) / np.maximum(n, 1))[:, None]).sum(axis=1), 0.0)
                names = pa.array(np.where(n > 0, np.array(langs, object)[best], UNDECIDED), pa.string())
            yield pa.StructArray.from_arrays([names, pa.array(score)], ["lang_pred", "score"])

    return score


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of docs, then lang_pred and score (0 to 1).

    The prediction reads the text alone. A null text, one without a letter and any text under
    a model without languages give `und` with score 0. Ties go to the language that comes first
    in the alphabet. Columns of docs with these two names are replaced; an empty table gives
    an empty table.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(compact(model))
    told = F.arrow_udf(scorer(held), "lang_pred string, score double")
    scored = docs.select(*own, told(F.col(text_col).cast("string").cast("binary")).alias("_told"))
    return scored.select(*own, F.col("_told.lang_pred").alias("lang_pred"), F.col("_told.score").alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()).select("doc_id", "lang", "text"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
