"""Point-cloud analytics expressed as PySpark DataFrames."""
