"""Structured Streaming forms of stateless transforms and metric-log aggregation."""
