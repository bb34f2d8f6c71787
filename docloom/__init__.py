"""Document-intelligence analytics on PySpark."""
