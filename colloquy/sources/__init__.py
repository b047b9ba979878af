"""Canonical input schemas, readers/writers, and adapters from the test tables."""
