"""Form readings to validated, traceable records, as Spark DataFrame operations."""

__version__ = "0.2"
