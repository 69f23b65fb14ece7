"""Ticket triage on Spark: DataFrames of support tickets in, DataFrames out."""
