"""Index, search, vectors, suggestions and expansion."""
