"""Scalar building blocks; Catalyst expressions wherever one exists."""
