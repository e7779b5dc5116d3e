"""A Spark-native engine that turns documents into structured records."""
