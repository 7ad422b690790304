"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from stowage.llm.embeddings import op5_embedding_near_dedup
from stowage.llm.exact import OP11_SQL, op11_exact_dedup
from stowage.llm.language import op1_language_id
from stowage.llm.licenses import op10_license_scans
from stowage.llm.packing import op8_packing
from stowage.llm.periods import op12_periodic_runs
from stowage.llm.pieces import op4_sentencepiece
from stowage.llm.quality import op7_quality_classifier
from stowage.llm.simhash import op3_simhash_near_dedup
from stowage.llm.syncmers import op6_syncmer_fingerprints
from stowage.llm.toxicity import op9_toxicity
from stowage.llm.urls import OP2_SQL, op2_url_filters
from stowage.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filters": op2_url_filters,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_syncmer_fingerprints": op6_syncmer_fingerprints,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_license_scans": op10_license_scans,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": OP2_SQL,
    "op11_exact_dedup": OP11_SQL,
}
