"""Composed tables and the catalogue of named queries."""
