"""Settings of the engine, and a hash that names a set of them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Config:
    # chunks
    max_chunk_tokens: int = 450
    overlap_tokens: int = 60
    min_chunk_chars: int = 80
    chars_per_token: int = 4
    hard_cap_ratio: float = 1.15
    min_page_chars: int = 20
    line_tolerance: float = 2.5
    column_gap: float = 12.0
    char_advance: float = 4.6
    # retrieval
    dense_k: int = 25
    bm25_k: int = 25
    rrf_k: int = 60
    top_n: int = 3
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    tau: float = 0.90
    rerank_chars: int = 2000
    # verification
    overlap_prefilter: float = 0.10
    judge_chars: int = 2500
    source_chars: int = 2500
    # conversations
    history_turns: int = 8
    rewrite_turns: int = 4
    rewrite_chars: int = 300
    rewrite_most: int = 400
    title_chars: int = 60
    list_limit: int = 30
    # quotas
    visitor_limit: int = 8
    global_limit: int = 300
    tokens_per_minute: int = 6000
    requests_per_minute: int = 30
    window_seconds: int = 60
    budget_seconds: int = 75
    upload_docs: int = 3
    upload_bytes: int = 25 << 20
    upload_pages: int = 400

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


DEFAULT = Config()
