"""Knowledge-retrieval and operations analytics as plain Spark DataFrame functions."""
