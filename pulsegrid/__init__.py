"""Regional engagement analytics as Spark DataFrame jobs."""
