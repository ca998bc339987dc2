"""Point-in-time portfolio analytics on Spark."""
