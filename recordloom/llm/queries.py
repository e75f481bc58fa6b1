"""The registered queries of the subpackage and the SQL beside those that SQL can express."""

from __future__ import annotations

from . import (bag_minhash, fill_in_middle, hnsw, kd_sharding, license_scan, line_dedup, merkle, nn_descent, packing,
               quality_rules, sentencepiece_unigram, suffix_dedup, warc)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_packing": packing.op3_packing,
    "op4_kd_shards": kd_sharding.op4_kd_shards,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_bag_minhash": bag_minhash.op7_bag_minhash,
    "op8_sentencepiece": sentencepiece_unigram.op8_sentencepiece,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_hnsw": hnsw.op10_hnsw,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_nn_descent": nn_descent.op12_nn_descent,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op9_warc_revisits": warc.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
