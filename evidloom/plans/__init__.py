"""Evidence-graph engine: plans."""
