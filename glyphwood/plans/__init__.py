"""Whole plans: from sources to a published index, and what keeps it in step."""
