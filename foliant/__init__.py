"""foliant: search and text mining over large collections of short documents, as Spark plans."""

__version__ = "0.1.0"
