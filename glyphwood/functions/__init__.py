"""functions of the document-index engine."""
