"""palimpsest: versioned-record analytics as PySpark DataFrame operators."""
