"""Business-registry and building-footprint analytics as Spark DataFrame jobs."""
