"""Operators for preparing training data; see queries.py."""
