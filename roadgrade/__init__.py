"""Steep roads, found and ranked on Spark."""
