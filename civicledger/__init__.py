"""Public-works governance analytics as PySpark DataFrame operators."""
