"""donorframe: variant-set comparison and corpus preparation on PySpark DataFrames."""

__version__ = "0.1.0"
