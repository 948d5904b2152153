"""Pipelines composed of operators: panel linkage, match models, cross-organization linkage, waves and batches."""
