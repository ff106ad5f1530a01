"""Readers: files (CSV, Parquet, JSON), named tables, remote stores, synthetic data."""
