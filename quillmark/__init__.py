"""quillmark: a PySpark-native analytics engine for logs, documents, clicks and search."""

__version__ = "0.1.0"
