"""Budgeted compressed-vector retrieval expressed as Spark DataFrame and SQL plans."""
