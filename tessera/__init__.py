"""Spark-first analytics over slide inventories, associations and releases."""
