"""Whole scans built from the operators, and the registry of named queries."""
