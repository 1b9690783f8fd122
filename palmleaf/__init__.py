"""Document ingestion, retrieval and analytics as Spark DataFrame plans."""
