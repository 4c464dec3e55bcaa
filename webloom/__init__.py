"""webloom: web-corpus analytics planned entirely as PySpark DataFrame operators."""
