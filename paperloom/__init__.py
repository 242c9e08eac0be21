"""A Spark-native engine for scanned business documents."""
