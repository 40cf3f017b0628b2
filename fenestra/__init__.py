"""Opening-schedule analytics as PySpark DataFrame operators."""
