"""The queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from inkmill.llm import bpe, decontamination, exact_dedup, fill_in_middle, language_id, lexical_search, license_scan, ngram_join, packing, pii, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_language_id": language_id.op4_language_id,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_packing": packing.op9_packing,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_bpe": bpe.op12_bpe,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLES = {"op3_license_scan": license_scan.ORACLE, "op6_url_filter": url_filter.ORACLE, "op2_decontamination": decontamination.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op10_ngram_join": ngram_join.ORACLE, "op11_fill_in_middle": fill_in_middle.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
