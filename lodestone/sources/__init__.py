"""sources of the evidence-retrieval engine."""
