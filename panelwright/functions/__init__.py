"""Column expressions: fiscal calendar, text keys, numeric helpers."""
