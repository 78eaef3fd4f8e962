"""Analytics on versioned public records, written for Spark."""
