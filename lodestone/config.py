"""All settings of the retrieval engine, validated, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace

PROFILES = ("corpus", "workspace")


@dataclass(frozen=True)
class EngineConfig:
    # Defaults of the query and index surface.
    embedding_dim: int = 384
    embedding_max_tokens: int = 512
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    rerank_max_tokens: int = 384
    rerank_batch_size: int = 4
    chunk_target_tokens: int = 600
    chunk_overlap_tokens: int = 80
    dense_top_k: int = 20
    sparse_top_k: int = 20
    rrf_k: int = 60
    fused_top_k: int = 20
    rerank_top_k: int = 5
    refusal_score_floor: float = -3.6
    refusal_dense_floor: float = 0.0
    near_miss_count: int = 3
    max_question_chars: int = 1000
    max_history_turns: int = 6
    rate_per_minute: int = 30
    workspace_max_bytes: int = 20_000_000
    workspace_max_pages: int = 200
    workspace_max_documents: int = 8
    workspace_max_sessions: int = 200
    workspace_ttl_seconds: int = 3600
    workspace_max_redirects: int = 5
    workspace_refusal_floor: float = -8.0
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    source_profile: str = "corpus"

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap_tokens < self.chunk_target_tokens:
            raise ValueError("the chunk overlap must be at least 0 and below the target")
        if self.rrf_k < 1:
            raise ValueError("rrf_k must be at least 1")
        if self.source_profile not in PROFILES:
            raise ValueError(f"unknown source profile {self.source_profile!r}")

    @property
    def effective_chunk_tokens(self) -> int:
        """No chunk may exceed what the encoder reads."""
        return min(self.chunk_target_tokens, self.embedding_max_tokens)

    def for_workspace(self) -> EngineConfig:
        """Settings of a workspace: its own refusal floor and wording."""
        return replace(self, refusal_score_floor=self.workspace_refusal_floor, source_profile="workspace")


DEFAULTS = EngineConfig()
