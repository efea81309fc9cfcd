"""Settings of the engine."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Config:
    store_path: str = "lodeleaf-store"
    audit_path: str = "audit.jsonl"
    chunk_size: int = 800
    chunk_overlap: int = 120
    embedder: str = "hashing"
    embedding_dim: int = 256
    st_model: str = "sentence-transformers/all-MiniLM-L6-v2"
    top_k: int = 5
    min_score: float = 0.0
    hybrid: bool = True
    hybrid_mode: str = "rrf"  # anything but "weighted" means reciprocal rank fusion
    bm25_weight: float = 0.5
    mmr_lambda: float = 0.3
    candidate_pool: int = 50
    structure_aware: bool = True
    structure_top_sections: int = 3
    history_turns: int = 2  # 0: none
    reasoning_rerank: bool = False
    reasoning_endpoint: str = "http://127.0.0.1:8080/v1"
    reasoning_model: str = "auto"
    reasoning_api_key: str = ""
    reasoning_candidates: int = 10
    llm_base_url: str = ""  # empty: extractive answers
    llm_api_key: str = ""
    llm_model: str = "auto"
    llm_timeout: float = 60.0
    offline_only: bool = True
    allow_network: bool = False
    default_acl: str = "public"

    def __post_init__(self) -> None:
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_size must be positive and chunk_overlap at least 0 and smaller")

    def but(self, **changes: object) -> Config:
        return replace(self, **changes)

    @property
    def is_offline(self) -> bool:
        return self.offline_only and not self.allow_network

    @property
    def method(self) -> str:
        return f"hybrid:{self.hybrid_mode}" if self.hybrid else "vector"

    def offline_environment(self) -> dict[str, str]:
        """Variables that keep model libraries off the network; for the driver and, as spark.executorEnv.*, the executors."""
        if not self.is_offline:
            return {}
        return {"HF_HUB_OFFLINE": "1", "TRANSFORMERS_OFFLINE": "1", "HF_HUB_DISABLE_TELEMETRY": "1"}

    def apply_offline_environment(self) -> None:
        os.environ.update(self.offline_environment())

    def fingerprint(self) -> str:
        """16 hex digits of the settings, without paths and secrets."""
        public = {k: v for k, v in asdict(self).items() if k not in ("store_path", "audit_path", "llm_api_key", "reasoning_api_key")}
        public |= {"llm_configured": bool(self.llm_base_url), "reasoning_configured": bool(self.reasoning_endpoint) and self.reasoning_rerank}
        return hashlib.sha256(json.dumps(public, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
