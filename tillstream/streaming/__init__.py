"""Structured Streaming forms of the operators, and the jobs built from them."""
