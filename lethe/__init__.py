"""Spark-native detection, grouping, masking and scoring of personal details in large text corpora."""
