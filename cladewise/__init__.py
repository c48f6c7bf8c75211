"""Cladewise: convergent differences between two groups across aligned columns, on Spark."""
