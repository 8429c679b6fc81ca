"""Registered queries and the post-processing flows that chain operators."""
