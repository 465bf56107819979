"""Spindrift: large-scale record linkage expressed as Spark DataFrame plans."""
