"""The operators that make sense on streams, with the same results as on tables."""
