"""Spark-native analytics over code-translation experiments and training corpora."""
