"""A Spark-native property graph, fact store and hybrid retrieval engine."""
