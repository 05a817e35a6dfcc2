"""Spark-native batch engine for star catalogues."""
