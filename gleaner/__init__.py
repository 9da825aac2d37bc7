"""Spark-native duplicate and hygiene analytics over file and document inventories."""
