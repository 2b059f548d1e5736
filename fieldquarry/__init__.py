"""Spatial survey analytics as DataFrame operators on Spark."""
