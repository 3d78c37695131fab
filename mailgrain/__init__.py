"""Mail-archive analytics on PySpark: rules, delivery state, MIME, auditing and data cleaning."""

__version__ = "0.1.0"
