"""Spark engine for document-format analytics and bulk format correction over a corpus."""
