"""Registered queries of the training-data operators: name -> (query, SQL or None)."""

from __future__ import annotations

from trialsift.llm import sql
from trialsift.llm.ann_forest import op1_hash_prefix_forest
from trialsift.llm.bpe_tree import op11_bpe_tree
from trialsift.llm.byte_cnn import op10_byte_cnn_quality
from trialsift.llm.centroid_dots import op13_centroid_dots
from trialsift.llm.cube_mix import op6_cube_mix
from trialsift.llm.dic_phrases import op12_dic_phrases
from trialsift.llm.drr_packing import op5_drr_packing
from trialsift.llm.feistel_order import op4_feistel_order
from trialsift.llm.license_minhash import op9_license_minhash
from trialsift.llm.quality_llr import op2_ngram_llr_quality
from trialsift.llm.seed_extend import op8_seed_extend_dedup
from trialsift.llm.trie_join import op3_jaccard_links, op3_ngram_jaccard_join
from trialsift.llm.zstd_lang import op7_zstd_language

QUERIES = {
    "op1_hash_prefix_forest": (op1_hash_prefix_forest, None),
    "op2_ngram_llr_quality": (op2_ngram_llr_quality, None),
    "op3_ngram_jaccard_join": (op3_ngram_jaccard_join, sql.OP3),
    "op3_jaccard_links": (op3_jaccard_links, sql.OP3_LINKS),
    "op4_feistel_order": (op4_feistel_order, None),
    "op5_drr_packing": (op5_drr_packing, None),
    "op6_cube_mix": (op6_cube_mix, None),
    "op7_zstd_language": (op7_zstd_language, None),
    "op8_seed_extend_dedup": (op8_seed_extend_dedup, sql.OP8),
    "op9_license_minhash": (op9_license_minhash, sql.OP9),
    "op10_byte_cnn_quality": (op10_byte_cnn_quality, None),
    "op11_bpe_tree": (op11_bpe_tree, None),
    "op12_dic_phrases": (op12_dic_phrases, sql.OP12),
    "op13_centroid_dots": (op13_centroid_dots, sql.OP13),
}
