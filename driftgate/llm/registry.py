"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from driftgate.llm import (
    chat_collapse,
    exact_dedup,
    hamming_search,
    language_id,
    license_scan,
    merkle_manifest,
    minhash_dedup,
    mixing,
    packing,
    personal_data,
    secret_scan,
    token_alignment,
    toxicity,
)

MODULES = (exact_dedup, mixing, hamming_search, chat_collapse, toxicity, language_id, secret_scan, minhash_dedup, license_scan, packing, personal_data, merkle_manifest, token_alignment)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in getattr(m, "SQL", {}).items()}
