"""ANSI-SQL forms of the registered queries, used to check their results."""
