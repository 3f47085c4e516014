"""Document and table analytics as ordinary Spark jobs."""
