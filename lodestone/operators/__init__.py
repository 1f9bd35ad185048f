"""operators of the evidence-retrieval engine."""
