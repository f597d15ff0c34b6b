"""Document retrieval data work as Spark DataFrame functions."""
