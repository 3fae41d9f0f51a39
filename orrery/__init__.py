"""Orrery: a PySpark-native engine for source-code knowledge bases."""
