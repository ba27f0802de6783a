"""Sources of the access-log jobs."""
