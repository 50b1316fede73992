"""Alignment, hard negatives and mixing against brute force, and on odd tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorecraft.llm import alignment, mixing, negatives

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None, "", " ", "  a  b ", "x▁y", "<|endoftext|> hi", "<s> a </s>", "日本語のテキスト", "a\n\n  b\tc\r\n", "é́ ﬁ Ⅷ", "　x　y", "<0x41>", "\U0001f600\U0001f600 a", "\x00a", "ab" * 500, "\n ", "a\x1c b",
    "wort " * 20_000,
]


# ---- alignment


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute(libraries, text):
    """Figures and linked id pairs of a text, from the libraries' own tokens."""
    t, s = libraries
    if not text:
        return (0, 0, 0, 0, ""), Counter()
    letters = {c: b for b, c in alignment.byte_letters().items()}
    a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
    raw_a = [bytes(map(letters.get, t.id_to_token(i))) for i in a]
    raw_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return (0, 0, 0, 0, ""), Counter()
    ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
    groups, found, i, j = [], Counter(), 0, 0
    for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
        p, q = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        for u in range(i, p):
            for v in range(j, q):
                if max(ends_a[u] - len(raw_a[u]), ends_b[v] - len(raw_b[v])) < min(ends_a[u], ends_b[v]):
                    found[a[u], b[v]] += 1
        i, j = p, q
    return (len(a), len(b), len(groups), sum(found.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()), found


def test_alignment_against_brute_force(spark, libraries, monkeypatch):
    rng = random.Random(3)
    mixed = ["".join(rng.choice(" \n\tabcé日\U0001f600<|0x>'s1") for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()
    texts = ODD_TEXTS + mixed + [r.text for r in docs] + ["the cat sat"] * 5
    d = spark.createDataFrame([(i if i % 9 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int")
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 3_000)
    rows, counts = alignment.aligned(d)
    told = [brute(libraries, t) for t in texts]
    linked = Counter(p for _, found in told for p in found)
    best = defaultdict(int)
    for (a, _), n in linked.items():
        best[a] = max(best[a], n)
    assert {(r.a_id, r.b_id): (r["count"], r.best) for r in counts.collect()} == {p: (n, n == best[p[0]]) for p, n in linked.items()}
    want = Counter(
        (i if i % 9 else None, *f[:4], sum(n for p, n in found.items() if linked[p] == best[p[0]]), sum(n * linked[p] for p, n in found.items()), f[4]) for i, (f, found) in enumerate(told)
    )
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows.collect())
    assert got == want


def test_cuts_of_intervals_without_a_shared_end_near_the_middle():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        a, b = (np.unique(np.r_[rng.integers(1, n, rng.integers(0, n)), n]) for _ in range(2))
        cut_a, cut_b = alignment.shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
        assert a[cut_a].tolist() == b[cut_b].tolist() == np.intersect1d(a, b).tolist()


def test_alignment_of_no_rows(spark):
    rows, counts = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"))
    assert not rows.collect() and not counts.collect()


# ---- hard negatives


def mined(rows, is_anchor):
    """By brute force: rows of (id, label, vector)."""
    usable = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in usable:
        if not is_anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: B023, E731
        others = sorted((-score(w), j, z) for j, z, w in usable if j != i)
        for p, j, _ in [o for o in others if o[2] == y][:5]:
            hard = [o for o in others if o[2] != y and 80 * -p <= 100 * -o[0] <= 100 * -p][:5]
            out += [(i, j, k + 1, o[1], -p, -o[0]) for k, o in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_against_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    dims = (64, 7, 20)[seed]
    centres = rng.normal(size=(6, dims))
    vectors = [(centres[k % 6] * (k % 3) + rng.normal(size=dims) * 0.7).tolist() for k in range(260)]
    rows = [(k, int(rng.integers(0, 4)), v) for k, v in enumerate(vectors)]
    rows += [(300 + k, k % 4, vectors[10]) for k in range(40)]  # equal vectors
    rows += [(400, None, vectors[0]), (401, 1, None), (402, 1, [None] * dims), (403, 1, [float("nan")] * dims), (404, 1, [float("inf")] * dims), (None, 1, vectors[1]), (405, 2, []), (406, 2, vectors[3][: dims - 2]), (407, 9, vectors[4]), (410, 3, [0.0] * dims)]
    d = spark.createDataFrame([(i, y, v, 1) for i, y, v in rows], "vec_id long, label int, embedding array<double>, row int")
    # many blocks, so that windows are merged across them
    for name, value in (("ROW_BLOCK", 90), ("ANCHOR_BLOCK", 7), ("TILE_PAIRS", 200)):
        monkeypatch.setattr(negatives, name, value)
    got = negatives.mine(d, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("seed", range(6))
def test_threshold_pairs_lose_none(seed):
    rng = np.random.default_rng(seed)
    dims = int(rng.integers(1, 40))
    scale = (rng.random(dims) ** 4 * 300).astype(np.int64) + 1
    x, q = (rng.integers(-scale, scale + 1, (n, dims)).astype(np.float64) for n in (300, 17))
    all_ = x @ q.T
    for share in (0.2, 0.9, 1.2):
        least = np.abs(all_).max(axis=0) * share
        least[0] = -1.0 if seed % 2 else least[0]
        i, j, s = negatives.threshold_pairs(x, q, least)
        want = np.argwhere(all_ >= least)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist())) and (s == all_[i, j]).all()


def test_large_components_stay_exact():
    x = np.array([[2.0**27 + 1, 3.0], [2.0**27, 5.0]])
    i, j, s = negatives.threshold_pairs(x, x, np.array([1.0, 1.0]))
    assert {(a, b): v for a, b, v in zip(i.tolist(), j.tolist(), s.tolist())} == {(a, b): sum(int(p) * int(q) for p, q in zip(x[a], x[b])) for a in range(2) for b in range(2)}


def test_negatives_of_no_rows(spark):
    d = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert not negatives.mine(d, F.col("vec_id") % 100 == 0).collect()


# ---- mixing


def test_mix_of_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, None, "a", 0), (2, "", "a", 0), (3, " \t\n", None, 0), (4, "one two", None, 0), (4, "one two", None, 0), (None, "x " * 500, "a", 0), (5, "wort " * 30_000, "b", 0), (6, " ", "c", 0), (7, "y", "", 0)], "doc_id long, text string, source string, shard int"
    )
    sizes, sources, spans = mixing.mix(odd)
    target = {r.source: (r.source_size, r.target) for r in sources.collect()}
    assert {k: v[0] for k, v in target.items()} == {"": 1, "a": 500, "b": 30_000, "c": 1, None: 4}
    assert sum(t for _, t in target.values()) == pytest.approx(1.5 * 30_506) and all(t <= 2 * s + 1e-9 for s, t in target.values())
    rows = {r._row: r for r in sizes.collect()}
    assert sorted(r.size for r in rows.values()) == [0, 0, 0, 1, 1, 2, 2, 500, 30_000]
    taken = Counter()
    for r in spans.collect():
        taken[r._row] += r.n_words
        assert 0 <= r.first_word and r.first_word + r.n_words <= rows[r._row].size and 0 <= r.shard < mixing.SHARDS
    assert all(n <= 2 * rows[k].size for k, n in taken.items())
    assert all(not spark_frame.collect() for spark_frame in mixing.mix(odd.limit(0)))


def test_seats_go_to_the_highest_quotients(spark):
    """Every prefix of shards is the apportionment of its own number of seats."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    sizes, sources, spans = mixing.mix(docs, shards=7)
    told = {r.source: r for r in sources.collect()}
    got = {(r.shard, r.source): r.quota for r in mixing.shard_quotas(sources, shards=7).collect()}
    for until in range(1, 8):
        seats = {s: sum(got[k, s] for k in range(until)) for s in told}
        queue = sorted(((-r.target / (2 * j - 1), r.source, j) for r in told.values() for j in range(1, mixing.COPIES * r.n_blocks + 1)))[: sum(seats.values())]
        assert Counter(s for _, s, _ in queue) == Counter({s: n for s, n in seats.items() if n})
    name = {r.sid: r.source for r in told.values()}
    blocks = Counter((r.shard, name[r.sid]) for r in spans.select("sid", "shard", "block", "copy").distinct().collect())
    assert blocks == Counter({k: n for k, n in got.items() if n})


def test_taken_words_come_near_their_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    sizes, sources, spans = mixing.mix(docs)
    taken = {r.sid: r.n for r in spans.groupBy("sid").agg(F.sum("n_words").alias("n")).collect()}
    assert all(abs(taken[r.sid] - r.target) <= mixing.BLOCK for r in sources.collect())
    # the same rows in another order and partitioning are mixed alike
    again = mixing.mix(docs.repartition(5))[2]
    key = ["id", "shard", "block", "copy", "first_word", "n_words"]
    assert sorted(map(tuple, spans.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))
    texts = mixing.mixed_texts(docs, spans)
    assert texts.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(taken.values())
