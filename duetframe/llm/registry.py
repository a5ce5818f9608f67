"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import bpe, fingerprints, html_extraction, jaccard, license_scan, packing, periodic_runs, quality, suffix_dedup, toxicity, url_filters, vector_codes, vector_links

MODULES = (url_filters, jaccard, license_scan, html_extraction, fingerprints, quality, bpe, suffix_dedup, toxicity, packing, vector_codes, periodic_runs, vector_links)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
