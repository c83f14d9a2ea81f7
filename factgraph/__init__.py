"""FactGraph: longitudinal records as immutable facts, with every other table a rebuildable projection on Spark."""

__version__ = "0.1.0"
