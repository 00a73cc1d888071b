"""Caudal: flow-network and training-data analytics as plain Spark plans."""
