"""Whole workflows, derived test tables and the query registry."""
