"""Spark operators for coding-agent session logs and the feeds around them."""

__version__ = "0.1.0"
