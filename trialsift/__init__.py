"""Evidence-assessment analytics over many trials at once, on PySpark."""
