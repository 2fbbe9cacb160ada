"""recollect: a PySpark-native engine for long-term-memory evaluation, retrieval and curation of dialogue data."""
