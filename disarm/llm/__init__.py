"""Operators for preparing training data: near copies, contamination, toxicity, packing, archives and the like."""
