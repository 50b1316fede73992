"""Operators of the text corpus against SQL and brute force, and on odd tables."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorecraft.llm import exact_dedup, langid, line_dedup, minhash, packing, quality, queries, sentencepiece_codec, sharding, substring_dedup, warc
from tests.test_oracles import duck, rows

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "The same line of text here\nshort\nAnother line that is long", "en", "a"), (2, "the same line of TEXT here  \nshort", None, "a"), (3, None, "en", None), (4, "", None, None),
    (4, "", None, None), (None, "The same line of text here", "de", "b"), (5, " \t\n\x0b ", "en", "b"), (6, "x" * 70_000, "en", "b"), (7, "wort " * 30_000, "de", "b"), (8, "日本語 テキスト", "fr", ""),
    (9, "The same line of text here\nshort\nAnother line that is long", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").select("*", F.lit(1).alias("n"), F.lit("x").alias("kept"), F.lit(2).alias("label"))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, name):
    ours = queries.QUERIES[name](spark, SF).toPandas()
    theirs = duck(queries.SQL[name], SF)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


APPLY = {
    "pack": lambda d: packing.pack_documents(d),
    "lines": lambda d: line_dedup.dedup_lines(d)[0],
    "pieces": lambda d: sentencepiece_codec.decode(sentencepiece_codec.encode(d)),
    "trips": lambda d: sentencepiece_codec.round_trips(d),
    "quality": lambda d: quality.clean_lines(d),
    "passages": lambda d: substring_dedup.repeated_passages(d),
    "language": lambda d: langid.identify(d, langid.fit(d)),
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "shards": lambda d: sharding.shard_documents(d),
    "near": lambda d: minhash.near_dedup(d),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_odd_and_empty_tables(spark, odd, name):
    assert APPLY[name](odd.limit(0)).count() == 0
    # a count alone would let Spark leave the operator out of the plan: every column is worked out
    got = APPLY[name](odd).collect()
    assert not got if name == "passages" else len(got) >= len(ODD)
    if name not in ("passages", "quality"):
        ids = [r["doc_id"] for r in got]
        assert {r[0] for r in ODD} <= set(ids) and ids.count(4) >= 2


def test_lines_of_odd_rows(odd):
    got = {(r.doc_id, r.text if r.text is None else r.text[:40]): (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(odd)[0].collect()}
    assert got[(2, "short")] == (2, 1)
    assert got[(9, "short")] == (3, 2)
    assert got[(None, "")] == (1, 1)
    assert got[(3, None)] == (1, 0)


def test_quality_of_odd_rows(odd):
    got = {r.doc_id: r for r in quality.clean_lines(odd).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[7].n_repeat_words == got[7].n_words == 30_000


def test_repeat_words_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcd"), n)) for n in (0, 1, 2, 3, 4, 5, 9, 40, 300)] + [" ".join(map(str, range(500)))]

    def brute(text):
        w = text.split()
        found = {}
        for i in range(len(w) - 2):
            found.setdefault(tuple(w[i : i + 3]), []).append(i)
        return len({i + k for p in found.values() if len(p) > 1 for i in p for k in range(3)})

    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.clean_lines(d).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_weak_digests_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    weak = exact_dedup.exact_dedup(docs, batches=3, digest=lambda c: F.concat(F.substring(F.sha2(c, 256), 1, 2), F.lit("0" * 14))).drop("text_sha256")
    theirs = duck(f"SELECT doc_id, keep_id, group_size, kept FROM ({exact_dedup.OP7_SQL})", SF)
    assert rows(weak.toPandas()) == rows(theirs)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 5000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    f = exact_dedup.fuse_filter(keys)
    assert exact_dedup.fuse_contains(*f, keys).all()
    assert exact_dedup.fuse_contains(*f, rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.02


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    p = packing.pack_documents(docs, with_ids=True).cache()
    pdf = p.toPandas()
    for _, g in pdf.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 4096 and (g["offset"].to_numpy() == g["length"].cumsum().shift(fill_value=0).to_numpy()).all()
    assert pdf.sequence_id.nunique() <= math.ceil(pdf["length"].sum() / 4096) * 1.02 + 1
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for r in docs.limit(40).collect():
        own = pdf[pdf.doc_id == r.doc_id].sort_values("piece")
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert b"".join(own.ids) == np.array(ids, "<u4").tobytes()
    assert packing.sequences(p).agg(F.sum("n_tokens")).first()[0] == pdf["length"].sum()


@pytest.mark.parametrize("seed", range(4))
def test_local_search_only_improves(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(300, 900, 200), np.repeat([1365, 1400, 700, 2048, 2100], 30)])
    before = packing.best_fit(lengths, 4096)
    after = packing.local_search(before, lengths, 4096)
    assert sorted(itertools.chain(*after)) == list(range(len(lengths)))
    assert max(lengths[b].sum() for b in after) <= 4096 and math.ceil(lengths.sum() / 4096) <= len(after) <= len(before)


@pytest.mark.parametrize(("low", "high", "n", "slack"), [(300, 900, 4000, 1.002), (1250, 1480, 3000, 1.05)])
def test_local_search_empties_bins(low, high, n, slack):
    lengths = np.random.default_rng(1).integers(low, high, n)
    before = packing.best_fit(lengths, 4096)
    after = packing.local_search([list(b) for b in before], lengths, 4096)
    assert len(after) < len(before) and len(after) <= slack * math.ceil(lengths.sum() / 4096)


def test_local_search_against_the_optimum():
    rng = np.random.default_rng(9)

    def fewest(left, bins):
        if not left:
            return len(bins)
        out = len(left) + len(bins)
        for k in range(len(bins)):
            if bins[k] + left[0] <= 100:
                out = min(out, fewest(left[1:], [*bins[:k], bins[k] + left[0], *bins[k + 1 :]]))
        return min(out, fewest(left[1:], [*bins, left[0]]))

    for _ in range(60):
        lengths = rng.integers(10, 90, int(rng.integers(1, 8)))
        best = fewest(sorted(lengths.tolist(), reverse=True), [])
        got = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
        assert best <= len(got) <= best + 1


def test_ids_equal_the_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    library, own = Tokenizer.from_file(path), packing.word_tokenizer(path)
    draw = random.Random(3)
    letters = "aAbBéÉİıſŉßẞÿŸŁłĲĳ's'S'll'Re0123.,;:!?*#<|endoftext|>$ \t\n\r\x0b\x0c\x1c\x85\xa0 ́¿«µªº²½字क़ਸ਼"
    texts = ["DİYARBAKIRİ!", "Sİ, ne", "a<|startoftext|>b!", *["".join(draw.choice(letters) for _ in range(draw.randint(1, 14))) for _ in range(3000)]]
    texts += [f"a{chr(c)}!, {chr(c)}b" for c in range(1, 0x3000, 7)]
    for t in texts:
        assert own(t.encode()) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_codec.MODEL))
    texts = ["", " ", "  a  b ", "日本語 テスト 😀", "tab\tnl\n\n end", "x" * 300, "ab" * 90 + "中"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sentencepiece_codec.decode(sentencepiece_codec.encode(d)).collect()
    assert all(list(r.ids) == sp.encode(r.text) and r.decoded == r.text for r in got)


def test_viterbi_against_brute_force():
    m = sentencepiece_codec.public_model()
    unknown = m.scores[m.kinds == sentencepiece_codec.NORMAL].min() - sentencepiece_codec.UNKNOWN_PENALTY
    words = ["▁their", "▁house", "nation", "中x中x中x"]
    for word in words:
        best = -np.inf
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
            parts = [word[a:b] for a, b in zip([0, *ends], ends)]
            if all(p in m.ids or len(p) == 1 for p in parts):
                best = max(best, sum(m.scores[m.ids[p]] if p in m.ids else unknown for p in parts))
        got = sentencepiece_codec.viterbi(m, sentencepiece_codec.code_points([word]))[0]
        assert math.isclose(sum(m.scores[i] if i >= 0 else unknown for _, _, i in got), best)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op6_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_words_scored_together_against_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    model = langid.fit(docs)
    words = ["the", "und", "haus", "zzqx", "𝒳y", "ß", "straßen", "qwertzuiop", "a" * 500, "été", "日本"]
    got = langid.WordScores(langid.compact(model)).of(words)
    for w, row in zip(words, got):
        want = langid.word_scores(model, w)
        assert np.allclose(row, 0 if want is None else want, atol=1e-5), w


def test_letters_alone_make_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    d = spark.createDataFrame([(1, "½ ② ²"), (2, "12 — 3"), (3, "the house"), (4, "x" * 200_000)], "doc_id long, text string").withColumn("score", F.lit(9))
    told = {r.doc_id: r for r in langid.identify(d, langid.fit(docs)).collect()}
    assert told[1].lang_pred == told[2].lang_pred == "und" and told[3].lang_pred == "en" and 0 <= told[4].score <= 1


def test_unknown_language(spark, odd):
    told = {r.doc_id: r for r in langid.identify(odd, langid.fit(odd)).collect()}
    assert told[3].lang_pred == told[4].lang_pred == told[5].lang_pred == "und" and told[3].score == 0


def test_passages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = substring_dedup.repeated_passages(docs).toPandas()
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    first, hit = {}, set()
    for i in sorted(words):
        keys = [tuple(words[i][j : j + 50]) for j in range(len(words[i]) - 49)]
        hit |= {i} if any(first.get(k, i) < i for k in keys) else set()
        for k in keys:
            first.setdefault(k, i)
    assert hit <= set(got.doc_id)
    for r in got.itertuples():
        shingles = [{tuple(w[k : k + 5]) for k in range(a, b - 4)} for w, a, b in ((words[r.doc_id], r.start_word, r.end_word), (words[r.other_id], r.other_start, r.other_end))]
        assert r.end_word - r.start_word >= 50 and len(shingles[0] & shingles[1]) >= 0.8 * len(shingles[0] | shingles[1]) and r.other_id < r.doc_id


def test_passages_inside_looser_stretches():
    words = [f"w{x}" for x in np.random.default_rng(7).integers(0, 10**9, 400)]
    other = list(words)
    for i in [*range(47, 200, 48), *range(212, 400, 15)]:
        other[i] = f"edit{i}"
    known = minhash.WordHash()
    hx, hy = (minhash.shingle_stream(" ".join(w), known) for w in (words, other))
    alike = hx == hy

    def similarity(i, j):
        met = int(alike[i:j].sum())
        return met / (2 * (j - i) - met)

    longest = max((j - i, i, j) for i in range(len(hx)) for j in range(i + 46, len(hx) + 1) if alike[i] and alike[j - 1] and similarity(i, j) >= 0.8)
    found = substring_dedup.passages(hx, hy, (0, len(hx) - 1, 0, len(hy) - 1), 50, 80)
    assert similarity(0, len(hx)) < 0.8 and longest[0] > 180
    assert (longest[1], longest[2] + 4) in {(s, e) for s, e, *_ in found}
    assert all(similarity(s, e - 4) >= 0.8 for s, e, *_ in found)


def test_windows_of_equal_words():
    def naive(g, least):
        out, todo = [], [(0, len(g))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo >= least:
                c = lo + int(g[lo:hi].argmin())
                out.append((lo, c, hi - 1))
                todo += [(lo, c), (c + 1, hi)]
        return out

    rng = np.random.default_rng(4)
    for n, values in ((300, 3), (200, 10**6), (120, 1)):
        g = rng.integers(0, values, n).astype(np.uint64)
        assert sorted(substring_dedup.compact_windows(g, 20)) == sorted(naive(g, 20))
    assert len(substring_dedup.compact_windows(np.zeros(200_000, np.uint64), 46)) == 200_000 - 45


def test_passages_of_repeated_ids(spark):
    rng = np.random.default_rng(8)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = own(60)
    docs = spark.createDataFrame([(1, own(40) + " " + shared), (2, own(90)), (2, own(20) + " " + shared)], "doc_id long, text string")
    assert {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(docs).collect()} == {(2, 1)}


def test_recall_of_inexact_passages(spark):
    """Planted passages of 50 to 200 words with up to 4 words changed and 0.8 of similarity or more."""
    rng = np.random.default_rng(11)
    rows_, planted = [], set()
    for k in range(150):
        n = int(rng.integers(50, 200))
        base = [f"p{k}_{x}" for x in range(n)]
        other = list(base)
        for at in rng.choice(np.arange(5, n - 5), int(rng.integers(0, 5)), replace=False):
            other[at] = f"e{k}_{at}"
        pad = lambda: " ".join(f"u{x}" for x in rng.integers(0, 10**9, 60))
        sets = [{tuple(w[i : i + 5]) for i in range(n - 4)} for w in (base, other)]
        rows_ += [(2 * k, f"{pad()} {' '.join(base)} {pad()}"), (2 * k + 1, f"{pad()} {' '.join(other)} {pad()}")]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            planted.add(2 * k + 1)
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = {r.doc_id for r in substring_dedup.repeated_passages(docs).collect()}
    assert len(planted) > 50 and len(planted & got) >= 0.97 * len(planted)


def test_planted_passage_is_cut(spark):
    rng = np.random.default_rng(3)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = own(60)
    docs = spark.createDataFrame([(1, own(80) + " " + shared + " " + own(30)), (2, own(70) + " " + shared + "\n" + own(50)), (3, own(200))], "doc_id long, text string")
    spans = substring_dedup.repeated_passages(docs)
    assert {(r.doc_id, r.other_id) for r in spans.collect()} == {(2, 1)}
    cut = {r.doc_id: r.text for r in substring_dedup.cut_passages(docs, spans).collect()}
    assert shared in cut[1] and shared not in cut[2] and len(cut[2].split()) == 120


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    hot = docs.unionByName(docs.limit(1).crossJoin(spark.range(100)).select((F.col("id") + 10**6).alias("doc_id"), "text"))
    got = sharding.shard_documents(hot).toPandas()
    sizes = got.groupby("shard").size().reindex(range(24), fill_value=0)
    assert sizes.max() - sizes.min() <= 1 and set(got.law) == {"rows"}
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    groups = got.groupby("text_crc32").agg(n=("shard", "size"), parts=("shard", "nunique"))
    assert (groups[(groups.n > 1) & (groups.n < 5)].parts == 1).mean() > 0.8


def test_near_copies_in_a_large_group(spark):
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in range(200)]
    texts = [" ".join(base)] + [" ".join(base[:k] + [f"n{i}"] + base[k + 1 :]) for i, k in enumerate(rng.integers(5, 195, 60))] + [" ".join(f"u{i}_{x}" for x in range(80)) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        break
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(docs).collect()}
    assert got == dict(enumerate(label))


@pytest.mark.parametrize("threshold", [70, 80, 95])
def test_near_copies_at_other_thresholds(spark, threshold):
    rng = np.random.default_rng(threshold)
    texts = []
    for g in range(12):
        base = [f"g{g}_{x}" for x in range(int(rng.integers(30, 120)))]
        for _ in range(6):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[at] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_dedup(docs, threshold=threshold).collect()} == dict(enumerate(label))


def test_a_threshold_that_the_sketch_cannot_tell_is_refused(spark):
    with pytest.raises(ValueError, match="too few"):
        minhash.near_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), threshold=30)


def test_warc_round_trip(spark):
    pages = [(1, "http://www.a.org/x?b=1#c", "<p>" + "same " * 40), (2, "https://b.a.org/y", "<p>" + "same " * 40), (3, None, None), (4, "http://a.org/x?b=1", "tiny"), (5, "http://a.org/z", "tiny"), (4, "http://a.org/x?b=1", "tiny"), (None, "bad://[", "é" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("size", F.lit(1))
    archive = warc.write_archive(df)
    got = warc.lookup(archive, df, payloads=True).collect()
    assert len(got) == len(pages) and sorted(bytes(r.payload).decode() for r in got if r.record_type == "response") == sorted(["<p>" + "same " * 40, "", "tiny", "tiny", "tiny", "é" * 200])
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(2, 1)}
    assert warc.lookup(warc.write_archive(df.limit(0)), df.limit(0)).count() == 0
    assert warc.surt("https://www.Example.com:8080/a/b?q=1#f") == "com,example:8080)/a/b?q=1"


def test_warc_lookup_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "PART_LINES", 50)
    df = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 3).cast("string"), F.lit(".org/")).alias("url"), F.col("id").cast("string").alias("html"))
    got = warc.lookup(warc.write_archive(df), df, payloads=True).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == sorted((i, str(i)) for i in range(300))


def test_pipeline_against_its_stages(spark):
    if not os.path.exists(os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")):
        pytest.skip("no pipeline")
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lengths = {}
    for name, stage in p.STAGES:
        before = docs
        docs = p.stored(stage(spark, docs, SF), name)
        lengths[name] = docs.count()
        if name != "packing":
            assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").count() == 0
    assert 0 < lengths["substring_dedup"] <= lengths["near_dedup"] <= lengths["line_dedup"] <= lengths["language"] <= 200
    # lines: by brute force over what the stage before kept
    kept = p.language(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    first: dict = {}
    rows_ = sorted((r.doc_id, r.text) for r in kept.collect())
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows_:
        for x in t.split("\n"):
            first.setdefault(key(x), i)
    want = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in rows_}
    got = {r.doc_id: r.text for r in p.lines(spark, kept, SF).collect()}
    assert got == {i: t for i, t in want.items() if t}
    for name, stage in p.STAGES:
        assert not stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).collect(), name


def test_pipeline_stages_keep_odd_rows_and_clashing_columns(spark):
    if not os.path.exists(os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")):
        pytest.skip("no pipeline")
    import corpus_pipeline as p

    extra = {c: F.lit(7) for c in ("score", "lang_pred", "n_lines", "n_dropped", "kept", "component_id")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(extra)
    odd_ = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", None, "a", 0), (None, "The house is on the hill and the sea is near.", "en", "a", 1), (9003, "wort " * 30_000, "de", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra)
    whole = docs.unionByName(odd_)
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, whole, SF).collect()
        assert got and all(r["score"] == r["n_lines"] == r["n_dropped"] == r["kept"] == 7 for r in got), name
        ids = [r["doc_id"] for r in got]
        if name != "language":
            assert 9001 in ids and None in ids, name
    packed = p.packed(spark, whole, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in whole.select("doc_id").collect()}
