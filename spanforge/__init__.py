"""Spark-first analytics over captured API traffic: columns, operators, streams and query plans."""
