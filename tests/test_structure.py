"""Structure of texts against brute force, and rules and sources by hand."""

import random

from pyspark.sql import functions as F

from lorecraft.functions import text as X
from lorecraft.operators import discovery as D
from lorecraft.operators import retrieval as R
from lorecraft.operators import rules as U
from lorecraft.operators import structure as S

MARKDOWN = """# One
First paragraph.
Still it.

Second paragraph.
## Two ##
```py
# no heading
~~~

```
| a | b |
| c | d |
text after
### Three
```` 
open to the end

# not a heading
"""


def test_blocks_by_hand():
    found = [(MARKDOWN[s:e], kind, path) for s, e, kind, path in S.blocks(MARKDOWN)]
    assert [(k, p) for _, k, p in found] == [
        ("heading", ("One",)), ("paragraph", ("One",)), ("paragraph", ("One",)), ("heading", ("One", "Two")), ("code", ("One", "Two")), ("table", ("One", "Two")),
        ("paragraph", ("One", "Two")), ("heading", ("One", "Two", "Three")), ("code", ("One", "Two", "Three")),
    ]
    assert found[1][0] == "First paragraph.\nStill it.\n" and found[4][0].startswith("```py") and found[8][0].endswith("# not a heading\n")
    assert [(b[2], b[1] - b[0]) for b in S.packed(S.blocks(MARKDOWN))][1] == ("paragraph", len("First paragraph.\nStill it.\n\nSecond paragraph.\n"))


def test_chunks_are_whole(spark):
    draw = random.Random(5)
    texts = ["", " \n", MARKDOWN] + ["".join(draw.choice(["word ", "long sentence. ", "x" * 900, "。", "\n", "\n\n", "# Head\n", "```\n", "| t |\n"]) for _ in range(draw.randint(1, 80))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string")
    by: dict = {}
    for r in S.chunks(docs, "doc_id", "text").collect():
        assert r.end - r.start <= S.CHUNK or r.kind == "heading"
        by.setdefault((r.doc_id, r.block), []).append((r.start, r.end))
    assert not [k for k in by if k[0] in (0, 1, 999)]
    for i, text in enumerate(texts):
        packed = S.packed(S.blocks(text))
        assert {b for d, b in by if d == i} == {b[0] for b in packed}
        for s, e, *_ in packed:
            spans = sorted(by[(i, s)])
            assert "".join(text[a:b] for a, b in spans) == text[s:e] and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_corpus_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, True), (2, "# T\n" + "body " * 200, False), (2, "again", True)], "doc_id long, text string, linked boolean")
    cards = spark.createDataFrame([(7, None, "x" * 400), (8, "t", "")], "id long, title string, text string")
    got = S.corpus(docs, cards, "doc_id", "text").collect()
    assert {r.type for r in got} == {"document", "card"} and all(r.embedding_text.startswith("T\n") for r in got if r.entry.startswith("document:2:4"))
    assert S.corpus(docs.limit(0), cards.limit(0), "doc_id", "text").collect() == []


def test_batches_follow_the_budget(spark):
    sizes = [10, 20, 90, 5, 5, 95, 1]
    d = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "k long, i long, n long")
    assert [r.batch for r in S.batches(d, "k", "i", "n", 100).orderBy("i").collect()] == [0, 0, 1, 1, 1, 2, 2]


def test_intents_by_hand(spark):
    want = {"保存这张": "card", "来源在哪": "citation", "薄弱点": "review", "探索新的": "discovery", "REVIEW my CARD": "review", "quiz": "explain", "source": "explain"}
    d = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.i for r in d.select("t", X.intent(F.col("t")).alias("i")).collect()} == want


def test_phrase_inside_words(spark):
    q = spark.createDataFrame([(1, "cat"), (2, "the"), (3, "cat nap")], "query_id long, query string")
    c = spark.createDataFrame([(1, "a concatenate word"), (2, "other"), (3, "bobcat naps here")], "doc_id long, text string")
    got = {(r.query_id, r.doc_id): (r.score, r.exact) for r in R.overlap(q, c, "doc_id", F.col("text"), F.col("query")).collect()}
    assert got == {(1, 1): (0.9, True), (1, 3): (0.9, True), (3, 3): (0.9, True)}


def test_near_pairs_against_all_pairs(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 30))) for _ in range(80)]
    texts += [t[3:] + "x" for t in texts[:20]]
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} or {t}

    def near(a, b):
        x, y = grams(a), grams(b)
        return a == b or (min(len(a), len(b)) >= 12 and (a in b or b in a)) or len(x & y) / max(1, min(len(x), len(y))) >= 0.7

    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    own = sorted(first.values())
    want = {(a, b) for a in own for b in own if a < b and near(texts[a], texts[b])}
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert {(r.a, r.b) for r in D.near_duplicates(d, "id", F.col("t")).collect()} == want


def test_pages_without_their_furniture():
    page = "<html><head><title>t</title><script>x()</script></head><body><header>Top</header><nav>Menu</nav><main><article><h1>Head</h1><p>One <b>two</b></p><aside>Ad</aside></article><article>short</article></main><footer>End</footer></body></html>"
    assert U.page_text(page, 1000) == ("Head\n\nOne two", "article", False)
    assert U.page_text("<body><p>a</p><form>no</form>b<br>c", 3) == ("a\nb", "page", True)
    assert U.page_text(None, 10) == ("", "page", False)
