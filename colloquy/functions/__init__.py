"""Column-level building blocks: exact ratios, rule regexes, event-time helpers."""
