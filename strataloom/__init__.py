"""strataloom: a Spark-native content-graph and hybrid-retrieval engine."""
