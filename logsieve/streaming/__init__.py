"""Streaming of the access-log jobs."""
