"""Operators on volumes: each takes and returns lazy DataFrames or Volumes."""
