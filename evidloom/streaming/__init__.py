"""Evidence-graph engine: streaming."""
