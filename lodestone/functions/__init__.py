"""functions of the evidence-retrieval engine."""
