"""Registered queries."""

from . import dialogue, feedback, records, reports, scoring, texts, turns
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dialogue", "feedback", "records", "reports", "scoring", "texts", "turns"]
