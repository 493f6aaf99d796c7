"""Yakınma: analytics over consumer complaints, written for Spark's DataFrame engine."""
