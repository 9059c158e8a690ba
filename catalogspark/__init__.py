"""catalogspark: open-data catalog analytics as Spark DataFrame, SQL and Structured Streaming jobs."""
