"""flowtide: network-flow security analytics on Apache Spark DataFrames."""

__version__ = "0.1.0"
