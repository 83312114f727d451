"""Chromatin-contact analytics expressed as Spark DataFrame jobs."""
