"""operators of the document-index engine."""
