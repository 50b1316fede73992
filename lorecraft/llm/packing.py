"""Best-fit packing with a swap-based local search.

Texts become token pieces of at most the capacity in the task that reads them. Pieces are
dealt by a hash into groups of a fixed size, which hold thousands of sequences each, and
every group is packed by itself: best fit, then a local search that moves and exchanges
pieces between underfull bins, always raising the sum of squared fill, until bins empty.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Pieces of a group, which one task packs.
GROUP_PIECES = 20_000
#: Chunks of text whose ids a task remembers, and bytes of the longest one of them.
REMEMBERED, REMEMBERED_BYTES = 400_000, 100

#: Chunks of printable ASCII and of the Latin letters that have one lower-case form and are composed.
_PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017f]+")
#: The pre-tokenizer's pieces of such chunks in lower case (fixed by the tokenizer file).
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkIds(dict):
    """Chunk between white space -> its little-endian unsigned 32-bit ids, worked out once for each chunk.

    Plain chunks are cut as the pre-tokenizer cuts them and each piece goes to the model alone;
    all others, and those that may hold a special token, go through the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.pieces = self.tokenizer.model, byte_letters(), {}

    def piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            known = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
            if len(piece) <= REMEMBERED_BYTES:
                self.pieces[piece] = known
        return known

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        chunk = raw.decode("utf-8", "replace")
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            chunk = chunk.lower()
            ids = self.piece(chunk) if chunk.isalpha() else b"".join(map(self.piece, _PIECES.findall(chunk)))
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(raw) <= REMEMBERED_BYTES:
            self[raw] = ids
        return ids


def word_tokenizer(path: str) -> Callable[[bytes], bytes]:
    """UTF-8 text -> little-endian unsigned 32-bit ids, by a tokenizer file whose pre-tokenizer drops white space."""
    of = ChunkIds(path).__getitem__
    # bytes.split knows ASCII white space only; other white space stays inside its chunk for the library
    return lambda raw: b"".join(map(of, raw.split()))


def public_word_tokenizer() -> Callable[[bytes], bytes]:
    import public_tokenizers

    return word_tokenizer(public_tokenizers.path(TOKENIZER))


def token_pieces(
    docs: DataFrame, id_col: str, text_col: str, tokenizer: Callable[[], Callable], capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids binary]): the pieces of every text with END_ID after it."""
    end = np.array([END_ID], "<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer()
        for batch in batches:
            rows, parts = [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or b"") + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    rows.append(row)
                    parts.append((piece, start // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
            columns = zip(*parts) if parts else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, shape)
    return out.withColumnRenamed("id", id_col)


# ---- packing one group


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that it fits."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # distinct free sizes that some bin has, sorted
    by_room: dict[int, list[int]] = {}

    def put(b: int, room: int) -> None:
        if room:
            if room not in by_room:
                bisect.insort(rooms, room)
                by_room[room] = []
            by_room[room].append(b)

    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            bins.append([i])
            put(len(bins) - 1, capacity - n)
            continue
        room = rooms[at]
        b = by_room[room].pop()
        if not by_room[room]:
            del by_room[room], rooms[at]
        bins[b].append(i)
        put(b, room - n)
    return bins


class Pool:
    """The pieces of open bins by size, with the sizes that are there as the bits of one number."""

    def __init__(self) -> None:
        self.by_size: dict[int, dict[int, int]] = {}
        self.bits = 0

    def add(self, size: int, piece: int, owner: int) -> None:
        self.by_size.setdefault(size, {})[piece] = owner
        self.bits |= 1 << size

    def take(self, size: int, piece: int) -> None:
        own = self.by_size[size]
        del own[piece]
        if not own:
            del self.by_size[size]
            self.bits &= ~(1 << size)

    def largest(self, size: int) -> int:
        """The largest size that is there and no larger; 0 where there is none."""
        return max(0, (self.bits & ((2 << size) - 1)).bit_length() - 1)

    def some(self, sizes: list[int]) -> list[tuple[int, int]]:
        """A (piece, owner) of each of these sizes, different ones for equal sizes."""
        seen: dict[int, Iterator] = {n: iter(self.by_size[n].items()) for n in sizes}
        return [next(seen[n]) for n in sizes]

    def best_two(self, size: int) -> tuple[int, int]:
        """Two sizes that are there, with the largest sum no larger than size; (0, 0) where there are none."""
        sizes = np.array(sorted(self.by_size), np.int64)
        sizes = sizes[: np.searchsorted(sizes, size, "left")]
        if not len(sizes):
            return 0, 0
        at = np.searchsorted(sizes, size - sizes, "right") - 1
        # a size that only one piece has can't be taken twice
        alone = np.array([len(self.by_size[s]) == 1 for s in sizes.tolist()])
        at = np.where(alone & (at == np.arange(len(sizes))), at - 1, at)
        total = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], 0)
        best = int(total.argmax())
        return (int(sizes[best]), int(sizes[at[best]])) if total[best] else (0, 0)


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Fewer bins, where moves and exchanges between underfull ones can empty some.

    The fullest underfull bin takes pieces from emptier ones as long as that fills it further:
    a move, an exchange of one for one, of two of its own for one, or of one for two, whichever
    fills it most. Each step makes the fuller of two bins fuller, so squared fill rises, no state
    comes back and the emptiest bins run dry. Then the next fullest one's turn comes; passes are
    made until the lower bound is met or one changes nothing.
    """
    size = [int(n) for n in lengths.tolist()]
    fill = {b: sum(size[i] for i in items) for b, items in enumerate(bins)}
    held = {b: list(items) for b, items in enumerate(bins)}
    least = math.ceil(sum(fill.values()) / capacity)
    changed = True
    while changed and len(held) > least:
        changed = False
        pool = Pool()
        for b in held:
            if fill[b] < capacity:
                for i in held[b]:
                    pool.add(size[i], i, b)
        order = [(-fill[b], b) for b in held if fill[b] < capacity]
        heapq.heapify(order)
        done: set[int] = set()
        while order:
            full, a = heapq.heappop(order)
            if a in done or a not in held or fill[a] != -full:  # it gave pieces away and stands in the heap again
                continue
            done.add(a)
            for i in held[a]:
                pool.take(size[i], i)
            gave: set[int] = set()
            while fill[a] < capacity and (step := best_step(held[a], size, capacity - fill[a], pool, fill, capacity)):
                out, into, back = step
                changed = True
                for i, b in into:
                    pool.take(size[i], i)
                    held[b].remove(i)
                    held[a].append(i)
                    fill[b] -= size[i]
                    fill[a] += size[i]
                    gave.add(b)
                for i in out:
                    held[a].remove(i)
                    held[back].append(i)
                    fill[back] += size[i]
                    fill[a] -= size[i]
                    pool.add(size[i], i, back)
            for b in gave:
                if held[b]:
                    heapq.heappush(order, (-fill[b], b))
                else:
                    del held[b], fill[b]
    return list(held.values())


def best_step(own: list[int], size: list[int], room: int, pool: Pool, fill: dict[int, int], capacity: int) -> tuple[list[int], list[tuple[int, int]], int] | None:
    """(pieces that leave, (piece, bin) that come instead, bin they leave to): what fills a bin of these pieces most."""
    best, out, sizes = pool.largest(room), [], None
    if best:
        sizes = [best]
    one = {size[i]: i for i in own}
    for n, i in one.items():
        if best < room and (gain := pool.largest(n + room) - n) > best:
            best, out, sizes = gain, [i], [n + gain]
    if best < room:
        # two of its own for one; a size stands for all pieces that have it, twice where there are two
        twice = sorted(own, key=size.__getitem__)
        twice = [i for k, i in enumerate(twice) if k < 2 or size[twice[k - 2]] != size[i]]
        for k, i in enumerate(twice):
            for j in twice[:k]:
                n = size[i] + size[j]
                if best < room and (gain := pool.largest(n + room) - n) > best:
                    best, out, sizes = gain, [i, j], [n + gain]
    how = sizes and (out, (into := pool.some(sizes)), into[0][1])
    if best < room:
        for n, i in one.items():
            two = pool.best_two(n + room)
            if best < room and sum(two) - n > best:
                into = pool.some([*two])
                # the piece leaves for one of the two bins, where that has room and squared fill still rises
                for (_, b), (_, other), came, gone in ((*into, *two), (*into[::-1], *two[::-1])):
                    after = fill[b] + n - came - (gone if b == other else 0)
                    if after <= capacity and after <= capacity - room + sum(two) - n:
                        best, how = sum(two) - n, ([i], into, b)
                        break
    return how or None


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; full lengths get bins of their own."""
    bin_, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths >= capacity)
    bin_[full] = np.arange(len(full))
    rest = np.flatnonzero(lengths < capacity)
    own = lengths[rest]
    for b, items in enumerate(local_search(best_fit(own, capacity), own, capacity)):
        at = 0
        for i in items:
            bin_[rest[i]], offset[rest[i]] = len(full) + b, at
            at += int(own[i])
    return bin_, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """All columns of pieces, then sequence_id and offset (long).

    Pieces are stored first, as the number of groups follows their number. Only lengths go to
    the tasks that pack; the other columns come back by a join. Lengths are 0 to capacity.
    Repeated rows are pieces of their own. An empty table gives an empty table; columns of these
    two names are replaced, and so is one named _piece_row.
    """
    pieces = stored(pieces.drop("sequence_id", "offset").withColumn("_piece_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(pieces.count() / GROUP_PIECES))
    # the number of the row tells repeated rows apart; a hash of it deals them evenly
    dealt = pieces.select(F.col("_piece_row").alias("of"), F.col(length_col).alias("length"), F.pmod(F.xxhash64("_piece_row"), F.lit(groups)).alias("group"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a task that is run again may get its rows in another order
        pdf = pdf.sort_values("of", ignore_index=True)
        bin_, offset = pack_lengths(pdf["length"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"of": pdf["of"], "sequence_id": bin_ * groups + int(pdf["group"].iloc[0]), "offset": offset})

    places = dealt.groupBy("group").applyInPandas(run, "of long, sequence_id long, offset long")
    return pieces.join(places, F.col("_piece_row") == F.col("of")).drop("_piece_row", "of")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids binary) from packed pieces that carry ids: the sequences themselves.

    A sequence holds capacity tokens at most, so its group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return own.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: Callable[[], Callable] = public_word_tokenizer, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each row of docs: id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Whole texts are tokenized and end with END_ID; only texts of more than capacity ids are
    cut, into pieces of capacity ids and a last one. A null text is an empty one, of one id. A
    null id is kept as it is; repeated ids and rows are documents of their own. Other columns
    are not read. An empty table gives an empty table.
    """
    return pack(token_pieces(docs, id_col, text_col, tokenizer, capacity, with_ids), capacity)


def op1_query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
