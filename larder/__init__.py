"""Food and recipe analytics on Spark."""
