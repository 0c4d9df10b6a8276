"""Attributed-graph analytics on Spark: co-occurrence, spectral features, nomination."""
