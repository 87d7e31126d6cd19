"""Operators over file tables and findings."""
