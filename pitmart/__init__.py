"""pitmart: point-in-time research marts expressed as Spark DataFrame jobs."""
