"""notewarp: a Spark-native engine that indexes and searches notes and media."""
