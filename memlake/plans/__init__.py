"""Composed plans and the catalogue of registered queries."""
