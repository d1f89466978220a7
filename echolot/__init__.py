"""Spark-native analytics over catalogs of sound files and the texts around them."""
