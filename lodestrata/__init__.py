"""Lodestrata: a PySpark-native analytics engine for code, dependency and advisory data."""
