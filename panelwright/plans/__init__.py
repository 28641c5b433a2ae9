"""Operators composed: the query catalogue, its reference SQL, and the end-to-end refresh."""
