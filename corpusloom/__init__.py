"""A Spark-native engine for preparing, indexing and searching text corpora."""
