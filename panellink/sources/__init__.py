"""Panels: column maps, partitioned Parquet, CSV, the synthetic fixture and scratch tables."""
