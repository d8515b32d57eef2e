"""glyphwood: a Spark-native hierarchical document-index engine."""
__version__ = "0.1.0"
