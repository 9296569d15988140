"""Demand-panel analytics as Spark DataFrame operators."""
