"""Column functions: URLs, page markup, text and digests, dates."""
