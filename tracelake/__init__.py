"""Spark-native analytics over agent trajectories, critic responses and corpora."""
