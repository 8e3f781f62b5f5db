"""Evidence analytics on Spark: ingestion, typed tables, retrieval, evidence and evaluation as DataFrame plans."""

__version__ = "0.1.0"
