"""Lodestrata: a PySpark-native engine for technical-document corpora."""
