"""Analytics for single-cell count matrices on Spark."""
