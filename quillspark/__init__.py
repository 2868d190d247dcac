"""A Spark-native engine for document corpora: ingest, score, search, label, draft."""
