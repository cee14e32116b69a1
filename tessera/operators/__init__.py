"""Operators on blocks, scans, codes and their checks."""
