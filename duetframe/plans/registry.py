"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            # numbers with a point are doubles on both sides
            ORACLES[key] = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", oracle)
        return f

    return add
