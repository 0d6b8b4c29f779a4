"""Training-data operators that run as Spark jobs over whole corpora."""
