"""Spark-native analytics for versioned, periodically released case records."""
