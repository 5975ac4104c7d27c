"""Statement language and the registry of queries."""
