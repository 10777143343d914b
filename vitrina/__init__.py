"""Listing analytics as lazy Spark DataFrame operators."""
