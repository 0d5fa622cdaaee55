"""Operators over job traces; each is a DataFrame-to-DataFrame function."""
