"""Edge-proof analytics on Spark."""
