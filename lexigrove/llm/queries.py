"""Queries of the training-data operators, and the SQL to hold them against."""

from . import chaining, decontaminate, license, mixing, mtree, neardup, sharding, suffixdedup, toxicity, warc

QUERIES = {
    "op1_winnowing_decontamination": decontaminate.op1_winnowing_decontamination,
    "op2_license_templates": license.op2_license_templates,
    "op3_bbit_minhash": neardup.op3_bbit_minhash,
    "op4_mtree_top_k": mtree.op4_mtree_top_k,
    "op5_external_shuffle": sharding.op5_external_shuffle,
    "op6_noisy_or_toxicity": toxicity.op6_noisy_or_toxicity,
    "op7_collinear_chaining": chaining.op7_collinear_chaining,
    "op8_warc_chunks": warc.op8_warc_chunks,
    "op9_entropy_balancing": mixing.op9_entropy_balancing,
    "op10_suffix_family": suffixdedup.op10_suffix_family,
}

ORACLE_SQL = {
    "op1_winnowing_decontamination": decontaminate.SQL,
    "op2_license_templates": license.SQL,
    "op3_bbit_minhash": neardup.SQL,
    "op4_mtree_top_k": mtree.SQL,
    "op8_warc_chunks": warc.SQL,
    "op9_entropy_balancing": mixing.SQL,
    "op10_suffix_family": suffixdedup.SQL,
}
