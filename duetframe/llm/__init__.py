"""Training-data operators: filters, near-duplicate joins, extraction, models, tokens and packing.

Nothing else in the library imports this subpackage.
"""
