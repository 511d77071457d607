"""Structured Streaming forms of the daily steps [P1-P3]."""
