"""Delivery analytics on Spark."""
