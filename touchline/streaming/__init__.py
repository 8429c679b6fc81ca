"""Structured Streaming bindings of the folds, running counters and frame order."""
