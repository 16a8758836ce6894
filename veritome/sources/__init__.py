"""Readers and writers: corpora, datasets, chunk and vector tables with owners, and caches."""
