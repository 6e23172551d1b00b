"""Tunables shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # They must equal the published defaults for results to match.
    chunk_max_characters: int = 900
    chunk_overlap_characters: int = 150
    embedding_dimensions: int = 256
    retrieval_top_k: int = 5
    retrieval_candidate_multiplier: int = 3
    retrieval_min_score: float = 0.1
    node_evidence_boost: float = 0.15
    max_question_characters: int = 1000
    max_upload_size_bytes: int = 25 * 1024 * 1024
    stale_job_timeout_seconds: int = 1800
    reaper_interval_seconds: int = 300
    replacement_min_text_characters: int = 12
    replacement_max_pages: int = 50
    node_evidence_chunks: int = 12
    root_evidence_chunks: int = 50
    max_node_children: int = 64
    max_evidence_sections: int = 24
    context_max_characters: int = 6000
    context_children: int = 8
    context_siblings: int = 6
    context_evidence_items: int = 6
    answer_max_characters: int = 600
    query_max_characters: int = 1200
    ancestor_limit: int = 10

    # Physical layout only; they never change a result.
    block_rows: int = 8192
    vector_block: int = 2048
    question_block: int = 512


DEFAULTS = Settings()
