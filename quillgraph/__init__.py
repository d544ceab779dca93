"""A Spark-native engine for document graphs and hybrid retrieval."""
