"""Change-risk analytics over many patches at once, as Spark dataflow."""

__version__ = "0.1.0"
