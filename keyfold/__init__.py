"""Set-level key-value, stream and text-corpus analytics as Spark DataFrame jobs."""
