"""Spark-first engine for building, searching and reporting on a text-and-vector library."""
