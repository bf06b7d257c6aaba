"""Agent-session analytics as functions from DataFrames to DataFrames."""
