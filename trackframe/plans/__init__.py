"""Whole pipelines: configuration, signal stages, clip building, match analysis, the clip database."""
