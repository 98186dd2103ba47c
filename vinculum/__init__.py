"""vinculum: Spark operators over citable text and token-level dependency graphs."""

__version__ = "0.1.0"
