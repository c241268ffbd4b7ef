"""symweave: a Spark-first engine for source-code graph analytics."""

__version__ = "0.1.0"
