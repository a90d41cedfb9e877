"""Text analytics on PySpark DataFrames: preparing, searching, scoring and auditing text collections."""
