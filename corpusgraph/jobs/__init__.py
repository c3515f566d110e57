"""Whole workloads: index building, question answering, report diagnosis."""
