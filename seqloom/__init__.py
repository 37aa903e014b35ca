"""A PySpark engine for large sequence collections."""
