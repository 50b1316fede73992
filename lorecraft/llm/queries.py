"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, exact_dedup, langid, line_dedup, minhash, mixing, negatives, packing, quality, sentencepiece_codec, sharding, substring_dedup, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_query,
    "op2_line_dedup": line_dedup.op2_query,
    "op3_sentencepiece": sentencepiece_codec.op3_query,
    "op4_quality_rules": quality.op4_query,
    "op5_substring_dedup": substring_dedup.op5_query,
    "op6_language_id": langid.op6_query,
    "op7_exact_dedup": exact_dedup.op7_query,
    "op8_warc": warc.op8_query,
    "op9_sharding": sharding.op9_query,
    "op10_minhash_near_dedup": minhash.op10_query,
    "op11_tokenizer_alignment": alignment.op11_query,
    "op12_hard_negatives": negatives.op12_query,
    "op13_mixing": mixing.op13_query,
}
SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_minhash_near_dedup": minhash.OP10_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_mixing": mixing.OP13_SQL,
}
