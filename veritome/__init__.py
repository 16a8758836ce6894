"""Grounded retrieval analytics on Spark: from pages to chunks, ranked passages, verified answers and their evaluation."""
