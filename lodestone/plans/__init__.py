"""plans of the evidence-retrieval engine."""
