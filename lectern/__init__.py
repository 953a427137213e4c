"""lectern: review text analytics on Spark."""
