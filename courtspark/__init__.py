"""Point-in-time analytics over contest records, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
