"""Analytics of dimensional inspection data on Spark."""
