"""Column functions and pluggable model adapters."""
