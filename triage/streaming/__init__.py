"""Tickets as a stream."""
