"""Signal-portfolio analytics on Spark."""
