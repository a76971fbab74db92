"""Web-risk analytics on Spark."""
