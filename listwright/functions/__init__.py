"""Column functions: text, URLs, dates, values, search."""
