"""What the whole pipeline returns, and what it leaves behind."""

import os
import zlib

import pytest

from lorecraft.llm import packing
from lorecraft.llm.common import settled, shared_dir, stored

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(__file__)


def left(spark):
    top = shared_dir(spark).removeprefix("file://") + "/lorecraft"
    return set(os.listdir(top)) if os.path.exists(top) else set()


def test_sequences_are_rebuilt_from_the_result(spark):
    if not os.path.exists(os.path.join(HERE, "..", "..", "corpus_pipeline.py")):
        pytest.skip("no pipeline")
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    before = left(spark)
    out = corpus_pipeline.run(spark, SF)
    # but for the result itself, nothing that the stages wrote is left
    assert len(left(spark) - before) == 1
    rows = out.collect()
    assert rows and all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    joined = {r.sequence_id: r for r in packing.sequences(out).collect()}
    for r in rows:
        whole = bytes(joined[r.sequence_id].ids)
        assert whole[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert all(r.n_tokens <= packing.CAPACITY and len(r.ids) == 4 * r.n_tokens for r in joined.values())
    # the ids of a document's pieces are those of a text that is left of it
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    words = {r.doc_id: set(t.encode(r.text or "", add_special_tokens=False).ids) | {packing.END_ID} for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import numpy as np

    assert all(set(np.frombuffer(r.ids, "<u4").tolist()) <= words[r.doc_id] for r in rows)


def test_settled_removes_what_was_stored_on_the_way(spark):
    before = left(spark)
    out = settled(spark, lambda: stored(stored(spark.range(5), "one"), "two").filter("id > 1"), "out")
    assert out.count() == 3 and len(left(spark) - before) == 1

    def fails():
        stored(spark.range(3), "lost")
        raise KeyError("x")

    now = left(spark)
    with pytest.raises(KeyError):
        settled(spark, fails, "never")
    assert left(spark) == now
