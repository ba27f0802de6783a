"""Sinks of the access-log jobs."""
