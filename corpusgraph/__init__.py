"""Spark jobs that turn page layouts, triples and reports into searchable tables."""
