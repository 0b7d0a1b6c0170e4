"""Pipelines, and the queries that exercise the operators."""
