"""Encoded frames as a stream."""
