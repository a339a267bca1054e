"""Content scanning and findings analytics on PySpark DataFrames."""
