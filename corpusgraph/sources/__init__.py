"""Readers and writers of the input and index tables."""
