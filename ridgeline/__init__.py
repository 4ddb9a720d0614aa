"""Spark-first analytics over gridded elevation data and the route graphs built on it."""
