"""seqloom: table work behind sequence recommenders, as Spark DataFrame functions."""

__version__ = "0.1.0"
