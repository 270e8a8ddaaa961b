"""Quillon: retrieval, curation and evaluation over text corpora, as Spark DataFrame operators."""
