"""Where documents come from, and where indexes are kept."""
