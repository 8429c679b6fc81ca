"""DataFrame operators. Every table has ``match_id``; keys and thresholds are parameters."""
