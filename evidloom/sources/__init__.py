"""Evidence-graph engine: sources."""
