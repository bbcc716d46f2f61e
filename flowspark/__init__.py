"""A Spark-native engine that folds layered records into a forest of bidirectional conversations."""
