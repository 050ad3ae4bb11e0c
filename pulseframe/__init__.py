"""Device telemetry analytics on PySpark DataFrames."""
