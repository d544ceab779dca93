"""Column functions: text, dates, vectors and scores."""
