"""Privacy-preserving text analytics as PySpark DataFrame transformations."""
