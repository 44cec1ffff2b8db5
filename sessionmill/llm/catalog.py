"""All queries of this subpackage."""

from __future__ import annotations

import importlib

from sessionmill.llm.registry import CHECKS, QUERIES

_MODULES = [
    "bpe", "chat_format", "collocations", "decontaminate", "exact_dedup", "near_dup", "pii", "prefix_trie", "quality", "secret_scan", "suffix_dedup", "token_counts", "url_filter",
]

for _module in _MODULES:
    importlib.import_module(f"sessionmill.llm.{_module}_queries")

__all__ = ["CHECKS", "QUERIES"]
