"""Indexes that follow a growing source by micro-batches."""
