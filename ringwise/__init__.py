"""Spark-native analytics over object catalogs, request logs, membership tables and cache traces."""
