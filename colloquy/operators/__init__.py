"""DataFrame operators of the dashboard (all built-in Spark expressions)."""
