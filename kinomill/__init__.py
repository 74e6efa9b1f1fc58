"""Scene retrieval and media-catalog analytics on PySpark."""

__version__ = "0.1.0"
