"""File tables, rule tables and the fixed dimension tables."""
