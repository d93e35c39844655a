"""Retail-panel planning and forecasting on Spark DataFrames."""
