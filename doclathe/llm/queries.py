"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLES.
MODULES = ("chat_format", "conversation_trie", "fingerprints", "importance", "license_scan", "mixing", "packing", "perplexity", "quality_rules", "sanitise", "simhash", "suffix_dedup", "url_filter")


def registered() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
