"""Spark-first analytics over versioned, evidence-cited records."""
