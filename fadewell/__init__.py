"""Spark library for wireless-channel measurements and other multi-axis series."""
