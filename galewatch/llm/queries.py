"""The operators' queries over their whole tables, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from galewatch.llm import bpe, filter_audit, line_dedup, mixing, ngram_join, packing, pii, quality, ranked_search, repeat_removal, secret_scan, url_filter, vector_dedup

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_mixing": mixing.op2_mixing,
    "op3_packing": packing.op3_packing,
    "op4_vector_dedup": vector_dedup.op4_vector_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_repeat_removal": repeat_removal.op6_repeat_removal,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_pii": pii.op8_pii,
    "op9_quality": quality.op9_quality,
    "op10_secrets": secret_scan.op10_secrets,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_bpe": bpe.op12_bpe,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op3_packing": packing.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
