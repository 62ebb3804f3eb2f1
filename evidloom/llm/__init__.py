"""Operators of a training-data pipeline: rules, scans, dedup, decontamination, packing, archives."""
