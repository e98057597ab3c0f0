"""Nearest-neighbour text tagging as Spark DataFrame jobs."""
