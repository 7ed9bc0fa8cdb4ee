"""Scene analytics and evaluation marts as PySpark DataFrame operators."""
