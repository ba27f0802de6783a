"""Access-log analytics as Spark jobs."""
