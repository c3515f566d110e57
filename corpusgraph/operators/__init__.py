"""Joins, alignment, retrieval, fusion and graph operators."""
