"""A Spark-native engine for code-quality and security findings."""
