"""corvana: a PySpark-native engine for news corpora (ingest, clean, de-duplicate, extract, graph, retrieve)."""

__version__ = "0.1.0"
