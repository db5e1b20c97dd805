"""Whole analyses composed from the operators, and the catalogue of registered queries."""
