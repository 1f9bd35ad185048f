"""streaming of the evidence-retrieval engine."""
