"""flowloom: network-flow analytics as Spark DataFrame, SQL and Structured Streaming jobs."""

__version__ = "0.1.0"
