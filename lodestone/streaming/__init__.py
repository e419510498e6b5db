"""Structured Streaming forms of the operators that follow changing rows."""
