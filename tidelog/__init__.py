"""A PySpark engine for ordered, versioned key-value data."""
