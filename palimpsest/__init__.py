"""Memory-graph analytics and conversation ETL on Spark."""

__version__ = "0.1.0"
