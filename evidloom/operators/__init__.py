"""Evidence-graph engine: operators."""
