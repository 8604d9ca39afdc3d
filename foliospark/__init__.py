"""A Spark-native engine for preparing documents for retrieval and measuring retrieval."""
