"""The registered queries of this subpackage and their SQL."""

from . import byte_bpe, flac, mixing, near_dedup, quality_knn, quality_rules, substring_dedup, suffix_dedup, url_filters, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality_knn": quality_knn.op2_quality_knn,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_flac": flac.op5_flac,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_url_filters": url_filters.op10_url_filters,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_url_filters": url_filters.ORACLE,
}
