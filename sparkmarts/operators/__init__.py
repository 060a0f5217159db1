"""Relational operators of the engine: staging, marts, reports and data-quality checks."""
