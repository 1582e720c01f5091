"""stemma: a Spark-native engine for structured-document knowledge bases."""
