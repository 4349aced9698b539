"""Evidence-screening analytics on PySpark."""
