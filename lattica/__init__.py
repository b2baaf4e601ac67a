"""Spark-native graph analytics: graphs as ordinary arc tables, algorithms as DataFrame plans."""
