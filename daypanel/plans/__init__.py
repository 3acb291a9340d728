"""Whole pipelines and the catalog of checked queries."""
