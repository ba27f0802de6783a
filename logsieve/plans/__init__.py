"""Plans of the access-log jobs."""
