"""Value-flow tracing and training-data operators as Spark jobs."""
