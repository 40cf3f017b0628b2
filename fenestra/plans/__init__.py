"""Whole plans composed from operators, and the driver-facing queries."""
