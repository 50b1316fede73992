"""Alignment of two tokenizations of the same text, and how often their tokens are linked.

Both tokenizations of a text cover the same bytes. Offsets where a token of each ends are shared
cuts; they are found by divide and conquer: near the middle of an interval of tokens an end of A
is looked up among the ends of B by bisection, in windows around the middle that double until one
is shared, and both halves go on alike; intervals without a shared cut are leaf groups. All
intervals of a slice of texts advance together as arrays.

A task writes a block for each slice of texts: its texts' figures, the distinct id pairs that
are linked in it, and for each text the places of its pairs in that list. So each pair of a block
is shuffled once, however many texts have it; the counts over all texts come back to the block
that asks for them, and no text leaves the task that reads it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .packing import byte_letters

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
#: Words whose ids a task remembers, and characters of the longest one of them.
REMEMBERED, REMEMBERED_CHARS = 300_000, 60
#: Characters of the texts of a block; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Characters of the texts that are aligned together.
SLICE_CHARS = 500_000
#: A word with the spaces before it; white space that meets the next word's spaces keeps them together.
_WORDS = re.compile(r" +(?:[^ ]*[^\S ] +)*[^ ]*")
_MEETS = re.compile(r"\s ")


@dataclass
class Tokenizer:
    """encode: text that begins with a space -> ids; spelled: the bytes of each id."""

    encode: Callable[[str], np.ndarray]
    spelled: list[bytes]


def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE file whose ids are its ranks; special tokens inside texts are plain text."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"] for t in told["added_tokens"]}
    letters = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(map(letters.__getitem__, token)): i for token, i in told["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelled = [b""] * (max(told["model"]["vocab"].values()) + 1)
    for token, i in ranks.items():
        spelled[i] = token
    return Tokenizer(lambda text: encoding.encode_to_numpy(text, disallowed_special=()), spelled)


def pieces(path: str) -> Tokenizer:
    """A SentencePiece file that puts a space before each text but an empty one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
    return Tokenizer(lambda text: np.array(model.encode(text[1:], num_threads=1) or [model.piece_to_id(MARK)]), spelled)


class Pair:
    """Two tokenizers, neither of which has tokens that cross from a word to the spaces before the next one.

    So words can be tokenized by themselves and remembered; new words of several texts go to the
    tokenizers as one text.
    """

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.sides = (a, b)
        self.n_bytes = tuple(np.array([len(t) for t in side.spelled]) for side in self.sides)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def spells(self, words: list[str]) -> list[tuple[bytes, bytes]] | None:
        """Little-endian 32-bit ids of each word; None if a tokenizer doesn't spell all of them byte for byte."""
        raw = [w.encode() for w in words]
        whole, bounds = b"".join(raw), np.cumsum([len(w) for w in raw])
        out = []
        for side, n_bytes in zip(self.sides, self.n_bytes):
            ids = side.encode("".join(words))
            ends = np.cumsum(n_bytes[ids])
            at = np.searchsorted(ends, bounds)
            if b"".join(map(side.spelled.__getitem__, ids.tolist())) != whole or (ends[at] != bounds).any():
                return None
            data, cuts = ids.astype("<i4").tobytes(), [0, *(4 * at + 4).tolist()]
            out.append([data[i:j] for i, j in zip(cuts, cuts[1:])])
        return list(zip(*out))

    def learn(self, words: list[str]) -> None:
        # a word that ends in white space ends its text, and would meet the spaces of another one here
        apart = [w for w in words if w[-1].isspace() or MARK in w]
        joined = [w for w in words if not (w[-1].isspace() or MARK in w)]
        told = self.spells(joined) if joined else []
        if told is None:
            apart, told, joined = words, [], []
        self.known.update(zip(joined, told))
        for w in apart:
            own = self.spells([w])
            self.known[w] = own[0] if own else None

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of a space and each text under both tokenizers; None where there is no text or one doesn't spell it."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = []
        for t in texts:
            t = " " + t if t else ""
            cut.append(_WORDS.findall(t) if _MEETS.search(t) else [" " + w for w in t[1:].split(" ")] if t else [])
        new = [w for w in {w for words in cut for w in words} if w not in self.known]
        if new:
            self.learn(new)
        out: list = []
        for words in cut:
            parts = list(map(self.known.__getitem__, words))
            out.append(tuple(np.frombuffer(b"".join(side), "<i4").astype(np.int64) for side in zip(*parts)) if parts and None not in parts else None)
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del self.known[w]
        return out


def public_pair() -> Pair:
    import public_tokenizers as P

    return Pair(byte_level(P.path(TOKENIZER_A)), pieces(P.path(TOKENIZER_B)))


# ---- alignment of a slice of texts


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers, then those of first[1], and so on."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) whose ends are shared, both in order.

    ends are offsets of increasing order; a and b bound the texts: text t has the tokens a[t] to
    a[t + 1] of A, and its last end is shared.
    """
    cut_a, cut_b = [a[1:] - 1], [b[1:] - 1]
    lo, hi, blo, bhi = a[:-1], a[1:], b[:-1], b[1:]
    while True:
        # an interval of one token is a leaf
        more = (hi - lo > 1) & (bhi - blo > 1)
        lo, hi, blo, bhi = lo[more], hi[more], blo[more], bhi[more]
        if not len(lo):
            break
        middle = (lo + hi - 2) >> 1
        at = np.searchsorted(ends_b, ends_a[middle])
        found = np.where(ends_b[at] == ends_a[middle], middle, -1)
        open_, reach = np.flatnonzero(found < 0), 1
        while len(open_):
            # ends within reach on both sides of the middle, but for an interval's last one
            first, last = np.maximum(lo[open_], middle[open_] - reach), np.minimum(hi[open_] - 2, middle[open_] + reach)
            n = last - first + 1
            near = spread(first, n)
            place = np.searchsorted(ends_b, ends_a[near])
            far = np.where(ends_b[place] == ends_a[near], np.abs(near - np.repeat(middle[open_], n)), len(ends_a))
            starts = np.cumsum(n) - n
            least = np.minimum.reduceat(far, starts)
            hit = least < len(ends_a)
            # the nearest, the earlier one of two
            own = np.flatnonzero(far == np.repeat(np.where(hit, least, -1), n))
            whose = np.searchsorted(starts, own, "right") - 1
            keep = np.r_[True, whose[1:] != whose[:-1]] if len(own) else np.zeros(0, bool)
            found[open_[whose[keep]]], at[open_[whose[keep]]] = near[own[keep]], place[own[keep]]
            whole = (first == lo[open_]) & (last == hi[open_] - 2)
            open_ = open_[~hit & ~whole]
            reach *= 2
        hit = found >= 0
        cut_a.append(found[hit])
        cut_b.append(at[hit])
        # both halves of those that were cut
        lo, hi, c = lo[hit], hi[hit], found[hit] + 1
        blo, bhi, d = blo[hit], bhi[hit], at[hit] + 1
        lo, hi, blo, bhi = (np.stack(pair, 1).ravel() for pair in ((lo, c), (c, hi), (blo, d), (d, bhi)))
    return np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))


def links(ends_a: np.ndarray, ends_b: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all overlaps: each ends where one of its tokens ends, both at a shared cut."""
    alone = np.ones(len(ends_b), bool)
    alone[cut_b] = False
    own = np.flatnonzero(alone)
    a = np.concatenate([np.arange(len(ends_a)), np.searchsorted(ends_a, ends_b[own])])
    return a, np.concatenate([np.searchsorted(ends_b, ends_a), own])


class Aligner:
    """Aligns slices of texts under two tokenizers."""

    def __init__(self, pair: Pair):
        self.pair, (self.size_a, self.size_b) = pair, map(len, pair.n_bytes)
        # an id and what follows it: inside a side, at the end of A's, inside B's, at the end of B's
        self.written = [f"{i}{mark}" for n, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in marks for i in range(n)]

    def run(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """Figures (n_a, n_b, n_groups, n_links, groups_sha256) of each text, and its distinct linked pairs: (text, pair, times)."""
        told = self.pair.encode(texts)
        have = [t for t, own in enumerate(told) if own]
        figures: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
        none = np.zeros(0, np.int64)
        if not have:
            return figures, none, none, none
        ids_a, ids_b = (np.concatenate([told[t][side] for t in have]) for side in (0, 1))
        a, b = (np.r_[0, np.cumsum([len(told[t][side]) for t in have])] for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.pair.n_bytes[0][ids_a]), np.cumsum(self.pair.n_bytes[1][ids_b])
        cut_a, cut_b = shared_cuts(ends_a, ends_b, a, b)
        first_a, first_b = np.r_[0, cut_a[:-1] + 1], np.r_[0, cut_b[:-1] + 1]
        # the order of groups: all of a group's A tokens, then its B tokens
        group_a, group_b = np.repeat(np.arange(len(cut_a)), cut_a + 1 - first_a), np.repeat(np.arange(len(cut_b)), cut_b + 1 - first_b)
        marks = np.empty(len(ids_a) + len(ids_b), np.int64)
        own_a, own_b = ids_a.copy(), ids_b + 2 * self.size_a
        own_a[cut_a] += self.size_a
        own_b[cut_b] += self.size_b
        marks[np.arange(len(ids_a)) + first_b[group_a]] = own_a
        marks[np.arange(len(ids_b)) + cut_a[group_b] + 1] = own_b
        ends = a[1:] + b[1:]
        groups = np.diff(np.searchsorted(cut_a, a))
        for k, t in enumerate(have):
            n_a, n_b, n = int(a[k + 1] - a[k]), int(b[k + 1] - b[k]), int(groups[k])
            line = "".join(map(self.written.__getitem__, marks[ends[k] - n_a - n_b : ends[k]].tolist()))
            figures[t] = (n_a, n_b, n, n_a + n_b - n, hashlib.sha256(line[:-1].encode()).hexdigest())
        left, right = links(ends_a, ends_b, cut_b)
        pairs = ids_a[left] * self.size_b + ids_b[right]
        whose = np.searchsorted(a, left, "right") - 1
        keys = np.sort(whose * (self.size_a * self.size_b) + pairs)
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        whose, pairs = np.divmod(keys[new], self.size_a * self.size_b)
        return figures, np.array(have)[whose], pairs, np.diff(np.r_[new, len(keys)])


def packed_ints(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unpacked_ints(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, id_col: str, text_col: str, pair: Callable[[], Pair]) -> DataFrame:
    """A row for each block of texts: block, ids, the figures of its texts as lists, pairs and docs (in how many texts), and the texts' pairs as packed integers."""
    kind = docs.schema[id_col].dataType.simpleString()
    lists = ["n_a", "n_b", "n_groups", "n_links", "n_pairs", "pairs", "docs"]

    def row(block: int, ids: pa.Array, figures: list[tuple], found: list[tuple]) -> pa.RecordBatch:
        whose, pairs, times = (np.concatenate(c) for c in zip(*found))
        own, code, docs_ = np.unique(pairs, return_inverse=True, return_counts=True)
        n_pairs = np.bincount(whose, minlength=len(ids))
        # places in the list grow inside a text, so their steps are small
        steps = np.diff(code, prepend=0)
        steps[(np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]] = code[(np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]]
        *numbers, sha = zip(*figures)
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        columns = [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[one(c, pa.int64()) for c in (*numbers, n_pairs, own, docs_)]]
        columns += [one(sha, pa.string()), pa.array([packed_ints(steps)], pa.binary()), pa.array([packed_ints(times)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", *lists, "sha", "steps", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(pair())
        block = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        figures: list[tuple] = []
        found: list[tuple] = []
        chars = 0
        for batch in batches:
            texts = batch.column(1)
            lengths = np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
            at = 0
            while at < len(texts):
                # as many texts as fit a slice, one at least
                end = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), SLICE_CHARS, "right")))
                told, whose, pairs, times = aligner.run(texts.slice(at, end - at).to_pylist())
                found.append((whose + len(figures), pairs, times))
                figures += told
                ids.append(batch.column(0).slice(at, end - at))
                chars += int(lengths[at:end].sum())
                at = end
                if chars >= BLOCK_CHARS:
                    yield row(block, pa.concat_arrays(ids), figures, found)
                    block, ids, figures, found, chars = block + 1, [], [], [], 0
        if figures:
            yield row(block, pa.concat_arrays(ids), figures, found)

    shape = f"block long, ids array<{kind}>, {', '.join(f'{c} array<long>' for c in lists)}, sha array<string>, steps binary, times binary"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, shape)


def pair_counts(of: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best) of blocks: in how many texts a pair is linked, and whether no pair of its A id is in more."""
    told = of.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = told.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.floor(F.col("pair") / size_b))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair: Callable[[], Pair] = public_pair) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the figures of each text, and (a_id, b_id, count, best) of all linked id pairs.

    rows has id_col, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256. A
    text that is null or empty, or that a tokenizer doesn't spell byte for byte, has no tokens:
    zeros and ''. Texts of any length are tokenized whole. Every row counts as a text, those
    that repeat an id or a text too; equal counts are all the highest. A null id is kept. Other
    columns are not read, whatever their names. An empty table gives empty tables.
    """
    size_b = len(pair().n_bytes[1])
    own = stored(blocks(docs, id_col, text_col, pair), "blocks")
    counts = stored(pair_counts(own, size_b), "counts")
    asked = own.select("block", F.posexplode("pairs").alias("place", "pair"))
    # a pair comes from each block once at most, so no key of this join holds more rows than there are blocks
    told = asked.join(counts, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    kind = docs.schema[id_col].dataType.simpleString()
    names = [*FIGURES, "n_best", "count_sum"]

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        column = lambda name: block.column(name).combine_chunks().flatten()
        n_pairs = column("n_pairs").to_numpy()
        total, first = int(n_pairs.sum()), np.cumsum(n_pairs) - n_pairs
        steps, times = (unpacked_ints(block.column(c)[0].as_py(), total) for c in ("steps", "times"))
        run_ = np.cumsum(steps)
        before = np.where(first > 0, run_[np.maximum(first - 1, 0)] if total else 0, 0)
        code = run_ - np.repeat(before, n_pairs)
        sums = [np.diff(np.r_[0, np.cumsum(values)][np.r_[first, total]]) for values in (times * best[code], times * count[code])]
        return pa.table([column("ids"), *[column(c) for c in FIGURES], *[pa.array(s, pa.int64()) for s in sums], column("sha")], ["id", *names, "groups_sha256"])

    shape = f"id {kind}, {', '.join(f'{c} long' for c in names)}, groups_sha256 string"
    rows = own.drop("pairs", "docs").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(run, shape)
    spelled = counts.select(F.floor(F.col("pair") / size_b).alias("a_id"), (F.col("pair") % size_b).alias("b_id"), "count", "best")
    return rows.withColumnRenamed("id", id_col), spelled


def op11_query(spark, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))[0]
