"""refrank: a Spark-native content-based paper recommender."""
