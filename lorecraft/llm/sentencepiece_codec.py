"""SentencePiece encoding and decoding in numpy batches.

A text is cut into words (a run of word marks with what follows it), which no piece crosses;
words of equal length form a matrix and advance together. The hash of every substring that
may be a piece is probed in the sorted piece keys. Unigram models take the segmentation of
the highest total score: one vectorised maximum for each end position, with backpointers.
BPE models are defined by their merges, not by a maximal sum, so that for them the same
probes find every adjacent pair that is a piece and a vectorised maximum takes the best one,
round after round.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces, as in the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
REMEMBERED = 300_000
#: Words of more code points are merged by a queue of pairs: a matrix would grow with the square.
MATRIX_CHARS = 48
#: Texts that a task holds the words of at once.
SLICE = 1024
#: What an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x100000001B3)
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Model:
    """What encoding and decoding need of a model file, with piece keys sorted by hash."""

    kind: int
    dummy_prefix: bool
    byte_fallback: bool
    unknown: int
    texts: list[bytes]
    kinds: np.ndarray
    ids: dict[str, int]
    scores: np.ndarray
    keys: np.ndarray
    key_ids: np.ndarray
    codes: np.ndarray
    longest: int
    byte_ids: np.ndarray


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


def hashed(codes: np.ndarray) -> np.ndarray:
    """Hash of each row."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k]
    return h


def load(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with the identity normalizer are read")
    pieces = proto.pieces
    usable = {p.piece: i for i, p in enumerate(pieces) if p.type in (NORMAL, USER, UNUSED)}
    if any(MARK in p.lstrip(MARK) for p in usable) or any(p.type == USER for p in pieces):
        raise ValueError("pieces that cross words or are given by the user are not read")
    longest = max(map(len, usable))
    keys, key_ids = [], []
    codes = np.zeros((len(pieces), longest), np.uint32)
    for n in range(1, longest + 1):
        own = [p for p in usable if len(p) == n]
        if own:
            c = code_points(own)
            keys.append(hashed(c))
            key_ids.append(np.array([usable[p] for p in own]))
            codes[key_ids[-1], :n] = c
    keys, key_ids = np.concatenate(keys), np.concatenate(key_ids)
    order = np.argsort(keys)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two pieces have one hash")
    byte_ids = np.full(256, -1)
    for i, p in enumerate(pieces):
        if p.type == BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
    texts = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in pieces]
    return Model(
        proto.trainer_spec.model_type, norm.add_dummy_prefix, bool((byte_ids >= 0).all()), next(i for i, p in enumerate(pieces) if p.type == UNKNOWN),
        texts, np.array([p.type for p in pieces]), usable, np.array([p.score for p in pieces], np.float64), keys[order], key_ids[order], codes, longest, byte_ids,
    )


def public_model() -> Model:
    import public_tokenizers

    return load(public_tokenizers.path(MODEL))


def prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes and powers of the base, from which that of any substring follows."""
    w, n = codes.shape
    p = np.zeros((w, n + 1), np.uint64)
    for k in range(n):
        p[:, k + 1] = p[:, k] * _BASE + codes[:, k]
    return p, np.array([pow(int(_BASE), k, 2**64) for k in range(n + 2)], np.uint64)


def probe(m: Model, codes: np.ndarray, hashes: tuple, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ids of the pieces that codes[row, start:end] are, or -1."""
    p, power = hashes
    n = end - start
    found = np.full(len(row), -1)
    ok = np.flatnonzero((n >= 1) & (n <= m.longest))
    row, start, end, n = row[ok], start[ok], end[ok], n[ok]
    # the hash of a row starts from its length
    h = n.astype(np.uint64) * power[n] + p[row, end] - p[row, start] * power[n]
    at = np.minimum(np.searchsorted(m.keys, h), len(m.keys) - 1)
    hit = np.flatnonzero(m.keys[at] == h)
    ids = m.key_ids[at[hit]]
    # the text itself decides
    k = np.arange(m.longest)
    own = codes[row[hit, None], np.minimum(start[hit, None] + k, codes.shape[1] - 1)]
    same = ((own == m.codes[ids]) | (k >= n[hit, None])).all(1)
    found[ok[hit[same]]] = ids[same]
    return found


def viterbi(m: Model, codes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, end, id or -1) of the highest-scoring segmentation of each row; shorter last pieces win ties."""
    w, n = codes.shape
    hashes, rows = prefixes(codes), np.arange(w)
    unknown = m.scores[m.kinds == NORMAL].min() - UNKNOWN_PENALTY
    best = np.full((w, n + 1), -np.inf)
    best[:, 0] = 0
    back, piece = np.zeros((w, n + 1), np.int64), np.full((w, n + 1), -1)
    for end in range(1, n + 1):
        most = min(m.longest, end)
        options, ids = np.full((w, most), -np.inf), np.full((w, most), -1)
        for k in range(1, most + 1):
            ids[:, k - 1] = got = probe(m, codes, hashes, rows, np.full(w, end - k), np.full(w, end))
            options[:, k - 1] = np.where(got >= 0, best[:, end - k] + m.scores[got], best[:, end - 1] + unknown if k == 1 else -np.inf)
        k = options.argmax(1)
        best[:, end], back[:, end], piece[:, end] = options[rows, k], end - 1 - k, ids[rows, k]
    out = []
    for r in range(w):
        end, own = n, []
        while end:
            own.append((int(back[r, end]), end, int(piece[r, end])))
            end = int(back[r, end])
        out.append(own[::-1])
    return out


def merged(m: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end and id or -1 of the pieces of all rows, and where each row's pieces end.

    The best adjacent pair that is a piece is merged, the leftmost of equals, until none is.
    """
    w, n = codes.shape
    hashes, rows = prefixes(codes), np.arange(w)
    starts = np.tile(np.minimum(np.arange(n + 2, dtype=np.int32), n), (w, 1))  # first places of the symbols, then n
    count = np.full(w, n)

    def scores(row: np.ndarray, pair: np.ndarray) -> np.ndarray:
        ids = probe(m, codes, hashes, row, starts[row, pair], starts[row, pair + 2])
        return np.where(ids >= 0, m.scores[ids], -np.inf)

    # the last column stands for pairs that don't exist
    score = np.full((w, n), -np.inf, np.float32)
    if n > 1:
        row, pair = np.nonzero(np.ones((w, n - 1), bool))
        score[row, pair] = scores(row, pair)
    active = rows
    col = np.arange(n + 1)[None, :]
    while n > 1:
        k = score[active].argmax(1)
        live = score[active, k] > -np.inf
        active, k = active[live], k[live]
        if not len(active):
            break
        # drops the boundary inside the merged pair; only the pairs on either side of it are new
        starts[active, : n + 1] = np.where(col <= k[:, None], starts[active, : n + 1], starts[active, 1:])
        score[active, : n - 1] = np.where(col[:, : n - 1] < k[:, None], score[active, : n - 1], score[active, 1:])
        count[active] -= 1
        score[active, k] = -np.inf
        left, right = k > 0, k < count[active] - 1
        score[active[left], k[left] - 1] = scores(active[left], k[left] - 1)
        score[active[right], k[right]] = scores(active[right], k[right])
    row = np.repeat(rows, count)
    sym = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin, end = starts[row, sym], starts[row, sym + 1]
    return begin, end, probe(m, codes, hashes, row, begin, end), np.cumsum(count)


def merged_by_queue(m: Model, word: str) -> list[tuple[int, int, int]]:
    """The same as merged, for one word of any length, in its length times a logarithm."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive, queue = [True] * n, []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < n and (i := m.ids.get(word[a : end[b]])) is not None:
            heapq.heappush(queue, (-m.scores[i], a, b, end[b]))

    for a in range(n - 1):
        offer(a, a + 1)
    while queue:
        _, a, b, e = heapq.heappop(queue)
        if not (alive[a] and alive[b] and after[a] == b and end[b] == e):
            continue
        alive[b] = False
        end[a], after[a] = e, after[b]
        if after[b] < n:
            before[after[b]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [(a, end[a], m.ids.get(word[a : end[a]], -1)) for a in range(n) if alive[a]]


def segment(m: Model, words: list[str]) -> dict[str, bytes]:
    """Little-endian 32-bit ids of each distinct word; words of one length go together."""
    out: dict[str, bytes] = {}
    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    for n, own in by_length.items():
        if m.kind == BPE and n <= MATRIX_CHARS:
            begin, end, ids, ends = merged(m, code_points(own))
            data, at = ids.astype("<i4").tobytes(), 0
            unknown = np.zeros(len(own), bool)
            unknown[np.searchsorted(ends, np.flatnonzero(ids < 0), side="right")] = True
            for word, odd, e in zip(own, unknown.tolist(), ends.tolist()):
                out[word] = with_bytes(m, word, zip(begin[at:e].tolist(), end[at:e].tolist(), ids[at:e].tolist())) if odd else data[4 * at : 4 * e]
                at = e
        else:
            for word, parts in zip(own, [merged_by_queue(m, w) for w in own] if m.kind == BPE else viterbi(m, code_points(own))):
                out[word] = with_bytes(m, word, parts)
    return out


def with_bytes(m: Model, word: str, parts) -> bytes:
    """The ids of parts, where what is no piece becomes its bytes or the unknown piece."""
    ids: list[int] = []
    for a, b, i in parts:
        if i >= 0:
            ids.append(i)
        elif m.byte_fallback:
            ids += m.byte_ids[list(word[a:b].encode("utf-8", "surrogatepass"))].tolist()
        else:
            ids.append(m.unknown)
    return np.array(ids, "<i4").tobytes()


def encoder(m: Model) -> Callable[[list[str]], list[np.ndarray]]:
    """texts -> arrays of ids; each distinct word is segmented once."""
    known: dict[str, bytes] = {}

    def run(texts: list[str]) -> list[np.ndarray]:
        cut = [_WORDS.findall((MARK * m.dummy_prefix + t if t else t).replace(" ", MARK)) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        known.update(segment(m, list({w for words in cut for w in words if w not in known})))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in cut]

    return run


def decoded_text(m: Model, ids: np.ndarray) -> str:
    text = b"".join(map(m.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if m.dummy_prefix and text[:1] == " " else text


def slices(column: pa.Array) -> Iterator[list]:
    for at in range(0, len(column), SLICE):
        yield column.slice(at, SLICE).to_pylist()


def encode(docs: DataFrame, text_col: str = "text", model: Callable[[], Model] = public_model) -> DataFrame:
    """All columns of docs, then ids array<int>; a null text gives null, an empty one no ids. `ids` of docs is replaced."""
    own = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode_ = encoder(model())
        for column in batches:
            out: list = []
            for texts in slices(column):
                out += [None if t is None else i for t, i in zip(texts, encode_([t or "" for t in texts]))]
            yield pa.array(out, pa.list_(pa.int32()))

    return docs.select(*own, F.arrow_udf(run, "array<int>")(F.col(text_col).cast("string")).alias("ids"))


def decode(docs: DataFrame, ids_col: str = "ids", model: Callable[[], Model] = public_model) -> DataFrame:
    """All columns of docs, then decoded string: the exact text that was encoded, but that a word mark in it becomes a space.

    Null ids give null; ids outside the model fail. `decoded` of docs is replaced.
    """
    own = [c for c in docs.columns if c != "decoded"]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model()
        for column in batches:
            yield pa.array([None if i is None else decoded_text(m, np.asarray(i, "<i4")) for ids in slices(column) for i in ids], pa.string())

    return docs.select(*own, F.arrow_udf(run, "string")(ids_col).alias("decoded"))


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Callable[[], Model] = public_model) -> DataFrame:
    """(id_col, n_ids, ids_crc32, decoded_sha256, round_trip) of every row: encoded, decoded and compared in one pass.

    The checksum is over little-endian 32-bit ids. A null text has nulls and a false round_trip;
    an empty one has no ids. Repeated rows and null ids are rows like others.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        encode_ = encoder(m)
        for batch in batches:
            rows: list = []
            for texts in slices(batch.column(1)):
                for text, ids in zip(texts, encode_([t or "" for t in texts])):
                    if text is None:
                        rows.append((None, None, None, False))
                        continue
                    again = decoded_text(m, ids)
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(again.encode("utf-8", "surrogatepass")).hexdigest(), again == text))
            n, crc, sha, same = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


def op3_query(spark, sf_dir: str) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
