"""Structured Streaming forms of the activity and history operators."""
