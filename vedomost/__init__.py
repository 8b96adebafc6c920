"""Document-to-register reconciliation on PySpark DataFrames."""

__version__ = "0.1.0"
