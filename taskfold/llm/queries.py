"""The queries of this subpackage, and DuckDB statements for those that SQL can express."""

from __future__ import annotations

from taskfold.llm import chunks, decontaminate, embeddings, language_model, licenses, minhash, mixing, periods, ranked, recipes, suffixes, toxicity, warc

QUERIES = {
    "op1_suffix_array_dedup": suffixes.op1_suffix_array_dedup,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing_sources": mixing.op4_mixing_sources,
    "op5_warc": warc.op5_warc,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_embedding_near_dedup": embeddings.op7_embedding_near_dedup,
    "op8_substring_dedup": chunks.op8_substring_dedup,
    "op9_lm_scoring": language_model.op9_lm_scoring,
    "op10_license_scans": licenses.op10_license_scans,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_exact_dedup": recipes.op12_exact_dedup,
    "op13_periodic_runs": periods.op13_periodic_runs,
}
ORACLE: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op4_mixing_sources": mixing.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_embedding_near_dedup": embeddings.OP7_SQL,
    "op11_ranked_search": ranked.OP11_SQL,
    "op12_exact_dedup": recipes.OP12_SQL,
}
