"""Web-archive analytics on Spark."""
