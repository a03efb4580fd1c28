"""textquarry: analytics over text extracted from software packages, as Spark plans."""

__version__ = "0.1.0"
