"""Document-screening analytics on Spark: sources, functions, operators, plans and streaming queries."""

__version__ = "0.1.0"
