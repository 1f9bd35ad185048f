"""Evidence retrieval and verification analytics, written as Spark DataFrame jobs."""
