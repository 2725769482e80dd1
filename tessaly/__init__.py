"""Tessaly: factor research and tabular analytics expressed as Spark plans."""
