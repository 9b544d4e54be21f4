"""Incremental variants of operators that are sums of independent contributions."""
