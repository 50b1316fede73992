"""Text functions against plain Python, on odd characters and long texts."""

import re
import time
import unicodedata

from pyspark.sql import functions as F

from lorecraft.functions import text as X
from lorecraft.operators import rules as U


def told(spark, texts, of):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", of(F.col("t")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_repetition_of_texts_and_of_a_long_one(spark):
    texts = ["", "a", "aa", "aba", "abab", "ababab", "abcabcab", "éé", "x。x。y", "x\u2003。x。\u00a0y", None, "ab" * 45, "a" * 7 + "b"]

    def once(t):
        t = t or ""
        p = next((p for p in range(1, max(len(t) // 2, 1) + 1) if len(t) % p == 0 and t[:p] * (len(t) // p) == t), len(t))
        parts = [x.strip(X.SEPARATORS) for x in re.split(r"[。！？!?；;\n]+", t[:p])]
        return "。 ".join(dict.fromkeys(x for x in parts if x))[:600]

    assert told(spark, texts, X.collapse_repetition) == [once(t) for t in texts]
    # counting the length at every possible period made this a matter of minutes
    begun = time.time()
    assert told(spark, ["ab" * 250_000 + "c"], X.collapse_repetition) == [("ab" * 300)]
    assert time.time() - begun < 20


def test_only_texts_that_nfkc_may_change_go_to_python(spark):
    plain = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), X.NOT_PLAIN.partition("&&")[2].removesuffix("]")))
    joined = {int(p[1], 16) for c in map(chr, range(0x110000)) if (d := unicodedata.decomposition(c)) and not d.startswith("<") and len(p := d.split()) == 2}
    joined |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for c in map(chr, range(0x80, 0x110000)):
        if not plain.match(c):
            assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and ord(c) not in joined
    texts = ["ascii", "Füße, naïve Żółć", "ﬁ", "Ａ１", "e\u0301", "가\u11a8", "한글", "汉字，可以", "\u00a0", "…", "", None, "😀", "²"]
    assert told(spark, texts, X.nfkc) == [t and unicodedata.normalize("NFKC", t) for t in texts]
    # Füße, ascii, 한글 and the like are null on their way there
    assert told(spark, texts, lambda t: F.rlike(t, F.lit(X.NOT_PLAIN)))[:3] == [False, False, True]


def test_quotes_with_separators_at_an_end_are_not_cited(spark):
    quotes = ["twenty characters 20", "nineteen character\u00a0x"[:19] + "\u00a0", "\u2003ineteen characters"[:20], "tab stays as it is\t\t"]
    rows = [(1, n, f"citation_{n}", "chunk_1", "doc_1", "summary", "text", "t", None, q, 0, len(q), None) for n, q in enumerate(quotes)]
    cited = spark.createDataFrame(rows, "card int, place int, id string, chunk string, doc string, claim string, type string, title string, url string, quote string, start int, end int, page int")
    assert sorted(r.place for r in U.valid_citations(cited, "card").collect()) == [0, 3]


def test_cited_query_on_short_texts_equals_its_sql(spark, tmp_path):
    from lorecraft.queries import QUERIES, SQL
    from tests.test_oracles import duck, rows

    texts = ["nineteen characters", "twenty characters 20", "twenty characters on and on", "nineteen characters ", "", None]
    spark.createDataFrame([(i, texts[i % 6]) for i in range(200)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    name = "FN23_valid_citations"
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck(SQL[name], tmp_path))


def test_embedding_in_blocks_equals_a_walk_over_bigrams(monkeypatch):
    import numpy as np

    from lorecraft.operators.rules import HashedBigrams

    rng = np.random.default_rng(9)
    texts = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in (0, 1, 2, 30, 7, 31, 200, 3)] + [None, " A  b ", ""]
    model = HashedBigrams()

    def walk(t):
        t, v = " ".join((t or "").lower().split()), np.zeros(64)
        for a, b in zip(t, t[1:]):
            h = (ord(a) * model.FIRST + ord(b) * model.SECOND) % 2**32
            v[(h >> 16) % 64] += 1 if h >> 31 else -1
        return v / (np.linalg.norm(v) or 1)

    want = np.array([walk(t) for t in texts])
    sizes = []
    bincount = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *rest: (sizes.append(len(x)), bincount(x, *rest))[1])
    for block in (1, 10, 33, 1 << 18):
        monkeypatch.setattr(HashedBigrams, "BLOCK", block, raising=False)
        sizes.clear()
        assert np.allclose(model.embed(texts), want) and max(sizes) <= block


def test_rows_of_terms_do_not_carry_the_set(spark):
    from lorecraft.operators import index, retrieval

    docs = spark.createDataFrame([(1, "alpha beta alpha")], "doc_id long, text string")
    passages = docs.selectExpr("doc_id AS owner", "0 AS entry", "'document' AS type", "true AS linked", "'' AS heading", "text")
    for rows in (retrieval.term_sets(docs, "doc_id", F.col("text")), index.indexed(passages)["postings"]):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        kept = re.findall(r"Generate explode\((\w+#\d+)\), \[([^\]]*)\]", plan)
        assert kept and all(made not in own for made, own in kept)
        assert {(r.n_terms, r.term) for r in rows.collect()} == {(2, "alpha"), (2, "beta")}


def test_texts_are_cut_into_words_once(spark):
    """No inferred filter works the words out again, and what follows reads the pairs that were written."""
    from lorecraft.operators import retrieval

    docs = spark.createDataFrame([(i, f"alpha beta word{i}") for i in range(9)] + [(9, ""), (10, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "alpha word3 gamma"), (2, "beta word"), (3, "")], "query_id long, query string")
    text, query = F.coalesce("text", F.lit("")), F.col("query")
    for rows in (retrieval.term_sets(docs, "doc_id", text), retrieval.postings(docs, "doc_id", text)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 2
    every = {(r.query_id, r.doc_id): r for r in retrieval.overlap(queries, docs, "doc_id", text, query).collect()}
    some = retrieval.overlap(queries, docs, "doc_id", text, query, 0.5)
    assert {(r.query_id, r.doc_id): r for r in some.collect()} == {k: r for k, r in every.items() if r.score >= 0.5} and len(every) == 18
    for rows in (some.filter("exact = false"), retrieval.bm25(queries, docs, "doc_id", text, query)):
        assert rows.count() and rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2 * 3
