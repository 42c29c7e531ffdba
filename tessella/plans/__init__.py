"""Whole dataflows, and the catalogue of registered queries with their SQL oracles."""
