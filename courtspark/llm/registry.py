"""The queries of this subpackage by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from . import decontaminate, exact_dedup, jaccard_join, license_scan, mixing, phrases, pseudo_likelihood, sharding, suffix_dedup, token_counts, toxicity, url_filter, whitening

MODULES = (pseudo_likelihood, mixing, license_scan, exact_dedup, token_counts, jaccard_join, url_filter, decontaminate, toxicity, sharding, phrases, suffix_dedup, whitening)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
