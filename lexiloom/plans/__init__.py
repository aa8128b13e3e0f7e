"""Pipelines: composition of DataFrame transforms from a description."""
