"""Low-supervision anomaly detection over text, written as Spark DataFrame jobs."""
