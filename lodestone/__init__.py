"""lodestone: a Spark-native text retrieval and ranking engine."""
