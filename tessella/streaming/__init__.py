"""Structured Streaming: per-session folds, file changes, activity clock."""
