"""Column functions: text, dates, JSON, vectors and HTML."""
