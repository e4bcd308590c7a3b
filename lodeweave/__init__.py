"""lodeweave: a Spark-native engine for code and knowledge retrieval."""
