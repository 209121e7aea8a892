"""Leafmill: document-research analytics as Spark DataFrame operators."""
