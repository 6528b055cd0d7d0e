"""parlance: conversation and corpus analytics as plain Spark DataFrame jobs."""
