"""A Spark-native engine for searching and maintaining a document archive."""
