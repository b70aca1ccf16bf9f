"""Mail-infrastructure analytics on Spark: resolve, classify, scan, analyze."""

__version__ = "0.1.0"
