"""Evidence-graph engine: functions."""
