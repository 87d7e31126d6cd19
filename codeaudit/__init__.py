"""Security auditing of large collections of source files, as Spark DataFrame plans."""
