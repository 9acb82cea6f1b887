"""Documentation retrieval as Spark jobs."""
