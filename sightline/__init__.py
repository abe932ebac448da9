"""A Spark-first engine for media provenance analytics."""
