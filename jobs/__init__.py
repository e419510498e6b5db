"""Runnable jobs over the given tables. Each has a command line, a config file and a function that takes a session."""
