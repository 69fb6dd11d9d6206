"""Web access-log analytics on Spark."""
