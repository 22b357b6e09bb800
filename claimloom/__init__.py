"""Evidence-backed knowledge graphs and corpus analytics as PySpark DataFrame operations."""
