"""The training-data queries: name -> callable (spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

from sessionloom.llm import decontaminate, html_text, language, licences, mixing, packing, pii, quality, simhash, topk, trie, warc, whitening

QUERIES = {
    "op1_license_scan": licences.op1_license_scan,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_exact_top_k": topk.op4_exact_top_k,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_language_id": language.op6_language_id,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_pii_weak_supervision": pii.op8_pii_weak_supervision,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_conversation_trie": trie.op12_conversation_trie,
    "op13_source_mixing": mixing.op13_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc_revisits": warc.OP7_SQL,
}
