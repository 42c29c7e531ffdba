"""Column functions: text, paths, JSON, vectors, provider settings."""
