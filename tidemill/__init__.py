"""Spark-native operators for code corpora and labelled datasets."""
