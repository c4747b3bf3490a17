"""City-travel and tensor analytics written as Spark DataFrame jobs."""
