"""Operators: splits, features, scoring, metrics, profiling, tracking, sinks."""
