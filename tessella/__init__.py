"""A PySpark engine for conversation logs, code graphs and corpora."""
