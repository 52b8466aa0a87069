"""Spark-native engine for building, tokenising and analysing text corpora."""
