"""Column functions: text normalisation, parsing, dates, request classification."""
